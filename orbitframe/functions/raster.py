"""Raster kernels on numpy arrays, and their use in Arrow batches; small SQL forms for tests and small images."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from orbitframe.session import bound_image_batches

#: Rows of a map that is broadcast, at most.
MAX_MAP = 65_536
IMAGE = "struct<height:int,width:int,channels:int,data:binary>"


def to_array(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    """Pixels of an image row: blue, green, red for three channels or more, without opacity."""
    px = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return px[..., :3] if channels > 3 else px


def gray(img: np.ndarray) -> np.ndarray:
    """Rounded luma of blue, green, red pixels; a single channel as it is."""
    if img.ndim == 2 or img.shape[2] == 1:
        return img.reshape(img.shape[:2])
    return np.rint(img[..., :3] @ np.array([0.114, 0.587, 0.299])).astype(np.uint8)


def blur_score(img: np.ndarray | None) -> float:
    """Population variance of the 4-neighbour Laplacian, borders mirrored without the edge; None gives 0."""
    if img is None or img.size == 0:
        return 0.0
    g = np.pad(gray(img).astype(float), 1, mode="reflect") if min(img.shape[:2]) > 1 else np.pad(gray(img).astype(float), 1, mode="edge")
    lap = g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]
    return float(lap.var())


def gaussian_blur(img: np.ndarray, sigma: float) -> np.ndarray:
    """Separable Gaussian of a radius of 4 sigma at most, borders mirrored without the edge."""
    r = max(1, min(int(round(sigma * 4)), min(img.shape[:2]) - 1))
    k = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma * sigma))
    k /= k.sum()
    out = img.astype(float)
    for axis in (0, 1):
        pad = [(r, r) if a == axis else (0, 0) for a in range(out.ndim)]
        x = np.pad(out, pad, mode="reflect")
        out = sum(w * np.take(x, range(i, i + img.shape[axis]), axis=axis) for i, w in enumerate(k))
    return out


def sharpen(img: np.ndarray, strength: float, sigma: float = 2.0) -> np.ndarray:
    """img (1 + s) - gauss s, rounded and held to 0..255."""
    soft = np.rint(gaussian_blur(img, sigma))
    return np.clip(np.rint(img * (1 + strength) - soft * strength), 0, 255).astype(np.uint8)


def resize(img: np.ndarray, width: int, height: int, nearest: bool = False) -> np.ndarray:
    """Nearest or bilinear resize; pixel centres are aligned."""
    h, w = img.shape[:2]
    if nearest:
        return img[np.minimum((np.arange(height) * h // height), h - 1)][:, np.minimum((np.arange(width) * w // width), w - 1)]
    y = np.clip((np.arange(height) + 0.5) * h / height - 0.5, 0, h - 1)
    x = np.clip((np.arange(width) + 0.5) * w / width - 0.5, 0, w - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    more = (slice(None),) * 2 + (None,) * (img.ndim - 2)
    fy, fx = (y - y0)[:, None][more], (x - x0)[None, :][more]
    a = img.astype(float)
    return (a[y0][:, x0] * (1 - fx) + a[y0][:, x1] * fx) * (1 - fy) + (a[y1][:, x0] * (1 - fx) + a[y1][:, x1] * fx) * fy


def dilate(mask: np.ndarray, size: int) -> np.ndarray:
    """Maximum over a size x size window around each pixel."""
    lo, hi = size // 2, size - 1 - size // 2
    for axis in (0, 1):
        x = np.pad(mask, [(lo, hi) if a == axis else (0, 0) for a in range(2)], constant_values=0)
        mask = np.max([np.take(x, range(i, i + mask.shape[axis]), axis=axis) for i in range(size)], axis=0)
    return mask


def detection_mask(probabilities: np.ndarray, width: int, height: int, invert: bool = True, feather: bool = False) -> np.ndarray:
    """One mask of all detections' probabilities (n, h, w): hard at over one half, or soft; dilated; inverted."""
    if len(probabilities) == 0:
        return np.full((height, width), 255 if invert else 0, np.uint8)
    top = probabilities.max(axis=0)
    if feather:
        mask = (resize(top, width, height) * 255).astype(np.uint8)
    else:
        mask = resize(((top > 0.5) * 255).astype(np.uint8), width, height, nearest=True)
    mask = dilate(mask, max(3, int(0.005 * width)))
    return 255 - mask if invert else mask


def _polynomial(img: np.ndarray, n: int = 5, sigma: float = 1.2) -> tuple[np.ndarray, np.ndarray]:
    """Local quadratic expansion (A, b) of each pixel under a Gaussian weight."""
    half = n // 2
    x = np.arange(-half, half + 1, dtype=float)
    g = np.exp(-(x**2) / (2 * sigma**2))
    g /= g.sum()

    def corr(a: np.ndarray, ky: np.ndarray, kx: np.ndarray) -> np.ndarray:
        p = np.pad(a, half, mode="reflect")
        rows = sum(k * p[i : i + a.shape[0]] for i, k in enumerate(ky))
        return sum(k * rows[:, i : i + a.shape[1]] for i, k in enumerate(kx))

    w = np.outer(g, g)
    yy, xx = np.meshgrid(x, x, indexing="ij")
    basis = np.stack([np.ones_like(xx), xx, yy, xx * xx, yy * yy, xx * yy])
    normal = np.einsum("iyx,jyx,yx->ij", basis, basis, w)
    moments = np.stack([corr(img, g, g), corr(img, g, g * x), corr(img, g * x, g), corr(img, g, g * x * x), corr(img, g * x * x, g), corr(img, g * x, g * x)])
    r = np.einsum("ij,jyx->iyx", np.linalg.inv(normal), moments)
    a = np.stack([np.stack([r[3], r[5] / 2]), np.stack([r[5] / 2, r[4]])])
    return a, r[1:3]


def dense_flow(prev: np.ndarray, cur: np.ndarray, scale: float = 0.5, levels: int = 3, window: int = 15, rounds: int = 3) -> np.ndarray:
    """Displacement (2, h, w) from two gray images by two-frame polynomial expansion over a pyramid."""
    sizes = [(max(16, int(prev.shape[0] * scale**k)), max(16, int(prev.shape[1] * scale**k))) for k in reversed(range(levels + 1))]
    flow = np.zeros((2, *sizes[0]))
    box = np.ones(window) / window
    half = window // 2

    def smooth(x: np.ndarray) -> np.ndarray:
        p = np.pad(x, half, mode="reflect") if min(x.shape) > half else np.pad(x, half, mode="edge")
        rows = sum(k * p[i : i + x.shape[0]] for i, k in enumerate(box))
        return sum(k * rows[:, i : i + x.shape[1]] for i, k in enumerate(box))

    for h, w in sizes:
        a, b = resize(prev.astype(float), w, h), resize(cur.astype(float), w, h)
        (a1, b1), (a2, b2) = _polynomial(a), _polynomial(b)
        flow = np.stack([resize(flow[0], w, h) * (w / flow.shape[2]), resize(flow[1], w, h) * (h / flow.shape[1])])
        gy, gx = np.mgrid[:h, :w]
        for _ in range(rounds):
            y = np.clip(np.rint(gy + flow[1]), 0, h - 1).astype(int)
            x = np.clip(np.rint(gx + flow[0]), 0, w - 1).astype(int)
            d = np.stack([x - gx, y - gy])
            m = (a1 + a2[:, :, y, x]) / 2
            db = -(b2[:, y, x] - b1) / 2 + np.einsum("ijyx,jyx->iyx", m, d)
            g11, g12, g22 = (smooth(v) for v in (m[0, 0] ** 2 + m[0, 1] ** 2, m[0, 1] * (m[0, 0] + m[1, 1]), m[0, 1] ** 2 + m[1, 1] ** 2))
            h1, h2 = smooth(m[0, 0] * db[0] + m[0, 1] * db[1]), smooth(m[0, 1] * db[0] + m[1, 1] * db[1])
            det = g11 * g22 - g12 * g12 + 1e-3
            flow = np.stack([(g22 * h1 - g12 * h2) / det, (g11 * h2 - g12 * h1) / det])
    return flow


def motion_input(img: np.ndarray | None, width: int = 256, height: int = 144) -> np.ndarray | None:
    """The small gray image that motion is measured on."""
    return None if img is None else np.rint(resize(gray(img), width, height)).astype(np.uint8)[..., None]


def area_resize(img: np.ndarray, width: int, height: int) -> np.ndarray:
    """Each pixel the mean of the source area it covers, with parts of source pixels by their share."""

    def shares(n: int, m: int) -> np.ndarray:
        edges = np.arange(m + 1) * (n / m)
        at = np.arange(n)
        return np.clip(np.minimum(edges[1:, None], at + 1) - np.maximum(edges[:-1, None], at), 0, None) / (n / m)

    out = np.einsum("yh,hw...,xw->yx...", shares(img.shape[0], height), img.astype(float), shares(img.shape[1], width))
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def preview(img: np.ndarray | None, yaw: float, pitch: float, roll: float, fov: float, size: int = 1024, widest: int = 4096) -> np.ndarray | None:
    """One view for the eye: sources wider than ``widest`` are scaled down by area; beyond the source is black, not wrapped."""
    if img is None:
        return None
    if img.shape[1] > widest:
        img = area_resize(img, widest, max(1, int(img.shape[0] * widest / img.shape[1])))
    return remap(img, *view_map(img.shape[0], img.shape[1], size, size, fov, yaw, pitch, roll), wrap=False)


def thumbnail(img: np.ndarray | None, size: int = 80) -> np.ndarray | None:
    """The centre square, scaled to size x size."""
    if img is None or not img.size:
        return None
    h, w = img.shape[:2]
    n = min(h, w)
    y, x = (h - n) // 2, (w - n) // 2
    return np.rint(resize(img[y : y + n, x : x + n], size, size)).astype(np.uint8)


def with_thumbnail(df: DataFrame, size: int = 80, image: str = "image", out: str = "thumbnail") -> DataFrame:
    """df with each image's thumbnail; null for unreadable ones."""
    return with_image_column(df, out, IMAGE, lambda px: thumbnail(px, size), image)


def with_preview(df: DataFrame, fov: float = 90.0, size: int = 1024, image: str = "image", out: str = "preview") -> DataFrame:
    """df (yaw, pitch, roll) with one view of each image for the eye; null for unreadable ones."""
    return with_image_column(df, out, IMAGE, lambda px, yaw, pitch, roll: preview(px, yaw, pitch, roll, fov, size), image, ("yaw", "pitch", "roll"))


def motion_score(prev: np.ndarray | None, cur: np.ndarray | None, width: int = 256, height: int = 144) -> float:
    """Mean flow magnitude of two frames scaled to width x height; None gives 0."""
    if prev is None or cur is None:
        return 0.0
    a, b = (resize(gray(x), width, height) for x in (prev, cur))
    return float(np.hypot(*dense_flow(a, b)).mean())


@lru_cache(maxsize=32)
def view_map(src_h: int, src_w: int, height: int, width: int, fov: float, yaw: float, pitch: float, roll: float) -> tuple[np.ndarray, np.ndarray]:
    """Source columns and rows that each pixel of a view looks at; kept in the worker for following frames."""
    a, b, c = map(math.radians, (yaw, pitch, roll))
    ry = np.array([[math.cos(a), 0, math.sin(a)], [0, 1, 0], [-math.sin(a), 0, math.cos(a)]])
    rx = np.array([[1, 0, 0], [0, math.cos(b), -math.sin(b)], [0, math.sin(b), math.cos(b)]])
    rz = np.array([[math.cos(c), -math.sin(c), 0], [math.sin(c), math.cos(c), 0], [0, 0, 1]])
    focal = (width / 2) / math.tan(math.radians(fov) / 2)
    y, x = np.mgrid[:height, :width]
    ray = np.stack([(x - width / 2) / focal, (y - height / 2) / focal, np.ones((height, width))])
    ray = np.einsum("ij,jyx->iyx", ry @ rx @ rz, ray)
    theta, phi = np.arctan2(ray[0], ray[2]), np.arcsin(np.clip(ray[1] / np.linalg.norm(ray, axis=0), -1, 1))
    return ((theta / (2 * math.pi) + 0.5) * src_w).astype(np.float32), ((phi / math.pi + 0.5) * src_h).astype(np.float32)


def remap(img: np.ndarray, u: np.ndarray, v: np.ndarray, lanczos: bool = False, wrap: bool = True) -> np.ndarray:
    """Gather of img at (u, v), wrapped on both axes or black beyond them; bilinear or 8-tap Lanczos; rounded for bytes."""
    if not wrap:  # a black frame as wide as the taps reach; what lies further out is in it too
        img = np.pad(img, [(5, 5), (5, 5)] + [(0, 0)] * (img.ndim - 2))
        u, v = np.clip(u + 5, 0, img.shape[1] - 1), np.clip(v + 5, 0, img.shape[0] - 1)
    h, w = img.shape[:2]
    x0, y0 = np.floor(u).astype(int), np.floor(v).astype(int)
    fx, fy = (u - x0).astype(float), (v - y0).astype(float)
    more = (...,) + (None,) * (img.ndim - 2)
    taps = (-3, -2, -1, 0, 1, 2, 3, 4) if lanczos else (0, 1)
    if lanczos:
        weigh = lambda f: (k := np.stack([np.sinc(t - f) * np.sinc((t - f) / 4) for t in taps])) / k.sum(axis=0)
    else:
        weigh = lambda f: np.stack([1 - f, f])
    wx, wy = weigh(fx), weigh(fy)
    out = 0.0
    for j, dy in enumerate(taps):
        rows = (y0 + dy) % h
        out = out + wy[j][more] * sum(wx[i][more] * img[rows, (x0 + dx) % w] for i, dx in enumerate(taps))
    return np.clip(np.rint(out), 0, 255).astype(np.uint8) if img.dtype == np.uint8 else out


def with_image_column(df: DataFrame, out: str, kind: str, f: Callable, image: str = "image", args: tuple[str, ...] = ()) -> DataFrame:
    """df with ``out`` = f(pixels or None, *args) of each row's image struct, in Arrow batches.

    An image result is an array, given back as an image struct; others must fit ``kind``.
    """
    bound_image_batches(df.sparkSession)
    schema = StructType([*df.schema.fields, *StructType.fromDDL(f"{out} {kind}").fields])
    columns = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            get = lambda c: b.column(columns.index(c)).to_pylist()
            values = []
            for img, *more in zip(get(image), *map(get, args)):
                good = img is not None and img["data"] is not None and (img["height"] or 0) > 0
                got = f(to_array(img["height"], img["width"], img["channels"], img["data"]) if good else None, *more)
                if isinstance(got, np.ndarray):
                    px = got if got.ndim == 3 else got[..., None]
                    got = {"height": px.shape[0], "width": px.shape[1], "channels": px.shape[2], "data": np.ascontiguousarray(px).tobytes()}
                values.append(got)
            arrow = pa.schema([*zip(b.schema.names, b.schema.types), (out, _arrow(kind))])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(values, _arrow(kind))], schema=arrow)

    return df.mapInArrow(run, schema)


def _arrow(kind: str) -> pa.DataType:
    if kind == IMAGE:
        return pa.struct([("height", pa.int32()), ("width", pa.int32()), ("channels", pa.int32()), ("data", pa.binary())])
    return {"double": pa.float64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}[kind]


def reproject(frames: DataFrame, views: DataFrame, size: int, fov: float, lanczos: bool = False) -> DataFrame:
    """frames x views with ``view_image``: each panorama seen by each virtual camera; unreadable frames give null.

    Views are a few dozen rows at most, so they are broadcast; maps are made once per worker and
    geometry, never shipped as rows.
    """
    both = frames.crossJoin(F.broadcast(views))

    def look(img, yaw, pitch, roll):
        return None if img is None else remap(img, *view_map(img.shape[0], img.shape[1], size, size, fov, yaw, pitch, roll), lanczos)

    return with_image_column(both, "view_image", IMAGE, look, args=("yaw", "pitch", "roll"))


def pixels(df: DataFrame, key: str, flat: str, width: int) -> DataFrame:
    """(key, x, y, value) of rasters in a flat array column."""
    p = df.select(key, F.posexplode(flat).alias("pos", "value"))
    return p.select(key, (F.col("pos") % width).alias("x"), F.floor(F.col("pos") / width).cast("int").alias("y"), F.col("value").cast("double").alias("value"))


def _at(flat: str, x, y, width: int):
    return F.get(F.col(flat), (y * width + x).cast("int")).cast("double")


def laplacian_sql(df: DataFrame, flat: str, width: int, height: int, out: str = "blur_score") -> DataFrame:
    """The blur score of small flat rasters by expressions alone."""
    mirror = lambda k, n: F.when(k < 0, -k).when(k > n - 1, 2 * (n - 1) - k).otherwise(k)

    def lap(pos):
        x, y = pos % width, F.floor(pos / width)
        near = sum(_at(flat, mirror(x + dx, width), mirror(y + dy, height), width) for dx, dy in ((0, -1), (0, 1), (-1, 0), (1, 0)))
        return near - 4 * _at(flat, x, y, width)

    laps = df.withColumn("_lap", F.transform(F.sequence(F.lit(0), F.lit(width * height - 1)), lap))
    n = float(width * height)
    mean = F.aggregate("_lap", F.lit(0.0), lambda s, v: s + v) / n
    laps = laps.withColumn("_mean", mean)
    var = F.aggregate("_lap", F.lit(0.0), lambda s, v: s + (v - F.col("_mean")) * (v - F.col("_mean"))) / n
    return laps.withColumn(out, var).drop("_lap", "_mean")


def dilated_sql(df: DataFrame, flat: str, width: int, height: int, size: int = 3) -> DataFrame:
    """df with the flat raster replaced by the maximum over size x size windows, inside the row: no row for each pixel, no shuffle."""
    lo, hi = size // 2, size - 1 - size // 2

    def top(values, pos):
        x, y = pos % width, F.floor(pos / width)
        inside = lambda k, n, d: (k + d >= 0) & (k + d < n)
        near = [F.when(inside(x, width, dx) & inside(y, height, dy), F.get(values, (pos + dy * width + dx).cast("int"))) for dy in range(-lo, hi + 1) for dx in range(-lo, hi + 1)]
        return F.greatest(*near) if len(near) > 1 else near[0]

    every = F.sequence(F.lit(0), F.lit(width * height - 1))
    # As an element of an array the raster is worked out once, not for each pixel.
    return df.withColumn(flat, F.get(F.transform(F.array(flat), lambda values: F.transform(every, lambda pos: top(values, pos))), F.lit(0)))


def gathered(df: DataFrame, key: str, flat: str, width: int, height: int, coords: DataFrame, bilinear: bool) -> DataFrame:
    """(key, px, py, value): small rasters seen through map rows (px, py, u, v), wrapped on both axes.

    This form is for maps of up to MAX_MAP rows, which are counted and broadcast; larger ones are made in the
    worker (see reproject).
    """
    if coords.limit(MAX_MAP + 1).count() > MAX_MAP:
        raise ValueError(f"the map has over {MAX_MAP} rows; use reproject")
    both = df.select(key, flat).crossJoin(F.broadcast(coords.select("px", "py", F.col("u").cast("double").alias("u"), F.col("v").cast("double").alias("v"))))
    if not bilinear:
        value = _at(flat, F.pmod(F.floor(F.col("u")), F.lit(width)), F.pmod(F.floor(F.col("v")), F.lit(height)), width)
        return both.select(key, "px", "py", value.alias("value"))
    both = both.withColumns({"x0": F.floor("u"), "y0": F.floor("v")}).withColumns({"fx": F.col("u") - F.col("x0"), "fy": F.col("v") - F.col("y0")})
    at = lambda dx, dy: _at(flat, F.pmod(F.col("x0") + dx, F.lit(width)), F.pmod(F.col("y0") + dy, F.lit(height)), width)
    top, low = at(0, 0) * (1 - F.col("fx")) + at(1, 0) * F.col("fx"), at(0, 1) * (1 - F.col("fx")) + at(1, 1) * F.col("fx")
    return both.select(key, "px", "py", (top * (1 - F.col("fy")) + low * F.col("fy")).alias("value"))
