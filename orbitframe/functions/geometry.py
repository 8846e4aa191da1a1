"""Virtual cameras: view layouts, rotations and rectilinear maps as DataFrames.

Axes: X right, Y down, Z forward; a positive pitch looks up.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

VIEW_SCHEMA = "view_idx int, name string, yaw double, pitch double, roll double"
#: The faces of the cube layout: name, yaw, pitch (None: the layout's pitch offset).
CUBE = (("Front", 0.0, None), ("Right", 90.0, None), ("Back", 180.0, None), ("Left", 270.0, None), ("Up", 0.0, 90.0), ("Down", 0.0, -90.0))


def with_views(rows: DataFrame, n: Column, pitch_offset: Column, layout: Column) -> DataFrame:
    """rows with the views of each one's layout (VIEW_SCHEMA), a row for each view.

    ``cube`` has six views whatever n is, ``fibonacci`` a spiral of n, any other name a ring of n. The offset tilts ring views and the four
    cube sides; on the spiral it is added without a limit. A layout has at most a few dozen views.
    """
    n, pitch_offset = F.greatest(n.cast("int"), F.lit(0)), pitch_offset.cast("double")
    sides = F.array(*(F.struct(F.lit(name).alias("name"), F.lit(yaw).alias("yaw"), F.lit(pitch).cast("double").alias("pitch")) for name, yaw, pitch in CUBE))

    def view(k: Column) -> Column:
        i, d = k.cast("double"), 2.0 / n
        y = F.lit(1.0) - i * d - d / 2
        phi, r = i * (math.pi * (3 - math.sqrt(5))), F.sqrt(1 - y * y)
        side, spiral, cube = F.get(sides, k), layout == "fibonacci", layout == "cube"
        name = F.when(cube, side["name"]).otherwise(F.concat(F.lit("View_"), k.cast("string")))
        yaw = F.when(cube, side["yaw"]).when(spiral, F.pmod(F.degrees(F.atan2(F.cos(phi) * r, F.sin(phi) * r)), F.lit(360.0))).otherwise(i * (360.0 / n))
        pitch = F.when(cube, F.coalesce(side["pitch"], pitch_offset)).when(spiral, F.degrees(F.asin(y)) + pitch_offset).otherwise(pitch_offset)
        return F.struct(k.cast("int").alias("view_idx"), name.alias("name"), yaw.alias("yaw"), pitch.alias("pitch"), F.lit(0.0).alias("roll"))

    count = F.when(layout == "cube", len(CUBE)).otherwise(n)
    places = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    return rows.select("*", F.inline(F.transform(places, view)))


def generate_views(spark: SparkSession, n: int, pitch_offset: float = 0.0, layout: str = "ring") -> DataFrame:
    """The views of one layout; see with_views."""
    return with_views(spark.range(1).select(), F.lit(n), F.lit(float(pitch_offset)), F.lit(layout))


def active_views(views: DataFrame, active: list[int] | None) -> DataFrame:
    """Views whose index is active; None keeps all, indices without a view are ignored."""
    return views if active is None else views.where(F.col("view_idx").isin([int(i) for i in active]))


def parse_active(text: str | None) -> list[int] | None:
    """Indices of a comma list; None and blank mean all views."""
    if text is None or not text.strip():
        return None
    return [int(x) for x in text.split(",") if x.strip()]


def rotation(yaw: Column, pitch: Column, roll: Column) -> list[list[Column]]:
    """Entries of Ry(yaw) Rx(pitch) Rz(roll), angles in degrees."""
    a, b, c = F.radians(yaw), F.radians(pitch), F.radians(roll)
    ca, sa, cb, sb, cc, sc = F.cos(a), F.sin(a), F.cos(b), F.sin(b), F.cos(c), F.sin(c)
    return [
        [ca * cc + sa * sb * sc, sa * sb * cc - ca * sc, sa * cb],
        [cb * sc, cb * cc, -sb],
        [ca * sb * sc - sa * cc, sa * sc + ca * sb * cc, ca * cb],
    ]


def rectilinear_map(views: DataFrame, src_w: int, src_h: int, width: int, height: int, fov: float | Column) -> DataFrame:
    """(view columns, px, py, u float, v float): where each output pixel looks in the panorama.

    ``fov`` in degrees, the same for all views or a column of theirs. Rays go through pixel corners, without a half-pixel shift. Meant for small sizes; large ones are
    computed inside the reprojection (see raster.reproject), never shipped as rows.
    """
    pixels = views.crossJoin(views.sparkSession.range(height).select(F.col("id").cast("int").alias("py")))
    pixels = pixels.crossJoin(views.sparkSession.range(width).select(F.col("id").cast("int").alias("px")))
    focal = (width / 2) / F.tan(F.radians(fov if isinstance(fov, Column) else F.lit(fov)) / 2)
    x, y, z = (F.col("px") - width / 2) / focal, (F.col("py") - height / 2) / focal, F.lit(1.0)
    rx, ry, rz = (r[0] * x + r[1] * y + r[2] * z for r in rotation(F.col("yaw"), F.col("pitch"), F.col("roll")))
    theta = F.atan2(rx, rz)
    phi = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), ry / F.sqrt(rx * rx + ry * ry + rz * rz))))
    u, v = (theta / (2 * math.pi) + 0.5) * src_w, (phi / math.pi + 0.5) * src_h
    return pixels.withColumns({"u": u.cast("float"), "v": v.cast("float")})
