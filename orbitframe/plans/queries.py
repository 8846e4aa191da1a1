"""The registered queries of the library's own operators, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from orbitframe.functions import geometry, gps, naming, raster
from orbitframe.operators import detections as det, frames as fr, telemetry as tel
from orbitframe.plans import extraction as ex, jobs, settings
from orbitframe.session import read_table
from orbitframe.sources import media, tracks
from orbitframe.streaming import keyframes, smart_blur

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

FRAMES_SQL = """frames as (
  select user_id as job_id, (row_number() over (partition by user_id order by ts, event_id) - 1)::int as frame_idx,
    epoch_us(ts) / 1e6 - 1704067200 as t, event_type as face, value as score, event_id
  from events)"""
SAMPLES_SQL = """samples as (
  select user_id as job_id, event_id as seq, epoch_us(ts) / 1e6 - 1704067200 as ts,
    (event_id * 37 % 2000) / 10.0::double - 100 as lat, (event_id * 53 % 4000) / 10.0::double - 200 as lon, value as alt
  from events where event_id % 3 = 0),
clean as (select * from samples where lat between -90 and 90 and lon between -180 and 180)"""
ALL_SAMPLES_SQL = SAMPLES_SQL.replace(" where event_id % 3 = 0", "")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    doubles = {f.name for f in df.schema if f.dataType.typeName() == "double"}
    return df.withColumns({c: ex.decimals(F.col(c), digits) if c in doubles else F.round(c, digits) for c in columns})


def _events(spark, sf):
    return read_table(spark, sf, "events")


def _frames(spark, sf):
    return ex.event_frames(_events(spark, sf))


# --- views and geometry


# Each customer's row gives a layout its settings: 1 to 7 views, a pitch offset of -12 to 12 degrees, a field of view of 60 to 99.
_SETTINGS_SQL = "s as (select c_custkey, (c_custkey % 7 + 1)::int as n, (c_nationkey - 12)::double as offs, (60 + c_custkey % 40)::double as fov from customer)"


def _layouts(spark, sf, layout):
    c = read_table(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") % 7 + 1).alias("n"), (F.col("c_nationkey") - 12).alias("offs"), (60 + F.col("c_custkey") % 40).cast("double").alias("fov"))
    return geometry.with_views(c, F.col("n"), F.col("offs"), F.lit(layout))


_VIEW = ("c_custkey", "view_idx", "name", "yaw", "pitch", "roll")


@query(f"with {_SETTINGS_SQL}, v as (select *, unnest(range(n)) as i from s) select c_custkey, i::int as view_idx, 'View_' || i as name, round(i * (360.0::double / n), 6) as yaw, offs as pitch, 0.0::double as roll from v")
def views_ring(spark, sf):
    return rounded(_layouts(spark, sf, "ring").select(*_VIEW), "yaw")


@query(f"""with {_SETTINGS_SQL} select c_custkey, view_idx, name, yaw, coalesce(pitch, offs) as pitch, roll from s, (values (0, 'Front', 0.0::double, null::double, 0.0::double), (1, 'Right', 90, null, 0), (2, 'Back', 180, null, 0),
  (3, 'Left', 270, null, 0), (4, 'Up', 0, 90, 0), (5, 'Down', 0, -90, 0)) v(view_idx, name, yaw, pitch, roll)""")
def views_cube(spark, sf):
    return _layouts(spark, sf, "cube").select(*_VIEW)


@query(f"""with {_SETTINGS_SQL}, v as (select *, unnest(range(n)) as i from s), a as (select *, 1 - i * 2.0::double / n - 1.0::double / n as y, i * (pi() * (3 - sqrt(5))) as phi from v)
select c_custkey, i::int as view_idx, 'View_' || i as name,
  round(case when degrees(atan2(cos(phi) * sqrt(1 - y * y), sin(phi) * sqrt(1 - y * y))) < 0 then 360 else 0 end
    + degrees(atan2(cos(phi) * sqrt(1 - y * y), sin(phi) * sqrt(1 - y * y))), 6) as yaw, round(degrees(asin(y)) + offs, 6) as pitch, 0.0::double as roll from a""")
def views_fibonacci(spark, sf):
    return rounded(_layouts(spark, sf, "fibonacci").select(*_VIEW), "yaw", "pitch")


_MAP_SQL = """with {settings}, v as ({views}), p as (select v.*, px, py, (px - {w} / 2.0::double) / f as x, (py - {w} / 2.0::double) / f as y
  from (select *, ({w} / 2.0::double) / tan(radians(fov) / 2) as f from v) v, range({w}) a(px), range({w}) b(py) {where}),
r as (select *, radians(yaw) as a, radians(pitch) as b from p),
q as (select *, cos(a) * x + sin(a) * sin(b) * y + sin(a) * cos(b) as rx, cos(b) * y - sin(b) as ry, -sin(a) * x + cos(a) * sin(b) * y + cos(a) * cos(b) as rz from r)
select c_custkey, view_idx, px::int as px, py::int as py, round(((atan2(rx, rz) / (2 * pi()) + 0.5) * {sw})::float::double, 2) as u,
  round(((asin(ry / sqrt(rx * rx + ry * ry + rz * rz)) / pi() + 0.5) * {sh})::float::double, 2) as v from q"""  # maps are of floats


def _map(views, w, sw, sh):
    m = geometry.rectilinear_map(views, sw, sh, w, w, F.col("fov"))
    return m.select("c_custkey", "view_idx", "px", "py", ex.decimals(F.col("u").cast("double"), 2).alias("u"), ex.decimals(F.col("v").cast("double"), 2).alias("v"))


@query(_MAP_SQL.format(settings=_SETTINGS_SQL, views="select c_custkey, fov, unnest(range(n))::int as view_idx, unnest(range(n)) * (360.0::double / n) + 7.3 as yaw, offs + 0.6 as pitch from s", w=4, sw=64, sh=32, where=""))
def rectilinear_map_small(spark, sf):
    # Turned a little, so that no value lies on the border of two roundings or of the panorama.
    return _map(_layouts(spark, sf, "ring").withColumns({"yaw": F.col("yaw") + 7.3, "pitch": F.col("pitch") + 0.6}), 4, 64, 32)


@query(_MAP_SQL.format(settings=_SETTINGS_SQL, views="select c_custkey, fov, view_idx, yaw, offs + 0.3 as pitch from s, (values (0, 0.0::double), (1, 90), (3, 270)) v(view_idx, yaw)", w=16, sw=400, sh=200, where="where px = 8 and py = 8"))
def cube_map_centres(spark, sf):
    views = geometry.active_views(_layouts(spark, sf, "cube"), [0, 1, 3]).withColumn("pitch", F.col("pitch") + 0.3)
    return _map(views, 16, 400, 200).where("px = 8 and py = 8")


@query(f"""with {FRAMES_SQL} select job_id, frame_idx, i::int as view_idx, 'View_' || i as name from frames, range(6) r(i) where i in (0, 2, 5)""")
def active_view_pruning(spark, sf):
    views = geometry.active_views(geometry.generate_views(spark, 6), geometry.parse_active("0, 2,5,99"))
    return _frames(spark, sf).crossJoin(F.broadcast(views)).select("job_id", "frame_idx", "view_idx", "name")


@query(f"with {FRAMES_SQL} select job_id, frame_idx, 'flat' as name, round(score, 6) as score from frames")
def flat_passthrough_scores(spark, sf):
    return rounded(_frames(spark, sf).select("job_id", "frame_idx", F.lit("flat").alias("name"), "score"), "score")


@query("""with c as (select px, py, (px * 1.3::double - 1.2) as u, (py * 0.9::double + 0.35 * px) as v from range(6) a(px), range(5) b(py))
select vec_id, px::int as px, py::int as py, round(embedding[((floor(v)::int % 8 + 8) % 8) * 8 + ((floor(u)::int % 8 + 8) % 8) + 1]::double, 6) as value from embeddings, c""")
def remap_nearest(spark, sf):
    c = _coords(spark)
    return rounded(raster.gathered(read_table(spark, sf, "embeddings"), "vec_id", "embedding", 8, 8, c, False), "value")


@query("""with c as (select px, py, (px * 1.3::double - 1.2) as u, (py * 0.9::double + 0.35 * px) as v from range(6) a(px), range(5) b(py)),
d as (select *, floor(u)::int as x0, floor(v)::int as y0, u - floor(u) as fx, v - floor(v) as fy from c),
e as (select vec_id, px, py, fx, fy,
  embedding[((y0 % 8 + 8) % 8) * 8 + ((x0 % 8 + 8) % 8) + 1]::double as a, embedding[((y0 % 8 + 8) % 8) * 8 + (((x0 + 1) % 8 + 8) % 8) + 1]::double as b,
  embedding[(((y0 + 1) % 8 + 8) % 8) * 8 + ((x0 % 8 + 8) % 8) + 1]::double as c, embedding[(((y0 + 1) % 8 + 8) % 8) * 8 + (((x0 + 1) % 8 + 8) % 8) + 1]::double as d from embeddings, d)
select vec_id, px::int as px, py::int as py, round((a * (1 - fx) + b * fx) * (1 - fy) + (c * (1 - fx) + d * fx) * fy, 6) + 0.0::double as value from e""")
def remap_bilinear_small(spark, sf):
    return rounded(raster.gathered(read_table(spark, sf, "embeddings"), "vec_id", "embedding", 8, 8, _coords(spark), True), "value").withColumn("value", F.col("value") + 0.0)


def _coords(spark):
    px, py = F.col("px"), F.col("py")
    grid = spark.range(6).select(F.col("id").cast("int").alias("px")).crossJoin(spark.range(5).select(F.col("id").cast("int").alias("py")))
    return grid.select("px", "py", (px * 1.3 - 1.2).alias("u"), (py * 0.9 + px * 0.35).alias("v"))


# --- sampling and filters


@query(f"with {FRAMES_SQL} select job_id, frame_idx, face from frames where frame_idx % 7 = 0")
def interval_sample_frames(spark, sf):
    step = fr.interval_step(F.lit(7.9), F.lit("Frames"), F.lit(30.0))
    return fr.sampled(_frames(spark, sf), step).select("job_id", "frame_idx", "face")


@query(f"with {FRAMES_SQL} select job_id, frame_idx from frames where frame_idx % trunc(greatest(1, (10 + job_id % 5 + 0.97::double) * 0.5))::int = 0")
def interval_sample_seconds(spark, sf):
    step = fr.interval_step(F.lit(0.5), F.lit("Seconds"), F.col("job_id") % 5 + F.lit(10.97))
    return fr.sampled(_frames(spark, sf), step).select("job_id", "frame_idx")


@query(f"with {FRAMES_SQL} select job_id, frame_idx, round(case when job_id % 4 > 0 then frame_idx / ((job_id % 4) * 10.0::double) else 0 end, 6) as t from frames")
def frame_timestamps(spark, sf):
    fps = (F.col("job_id") % 4) * 10.0
    return rounded(_frames(spark, sf).select("job_id", "frame_idx", fr.frame_time(F.col("frame_idx"), fps).alias("t")), "t")


@query(f"""with recursive {FRAMES_SQL}, k as (
  select job_id, frame_idx, score, score as last, true as keep from frames where frame_idx = 0
  union all
  select f.job_id, f.frame_idx, f.score, case when abs(f.score - k.last) > 40 then f.score else k.last end, abs(f.score - k.last) > 40
  from k join frames f on f.job_id = k.job_id and f.frame_idx = k.frame_idx + 1)
select job_id, frame_idx, round(score, 6) as score from k where keep""")
def adaptive_keyframes_scalar(spark, sf):
    kept = fr.adaptive_keyframes(_frames(spark, sf), 40.0, "score")
    return rounded(kept.select("job_id", "frame_idx", "score"), "score")


@query(SQL["adaptive_keyframes_scalar"].replace("select job_id, frame_idx, round(score, 6) as score from k", "select job_id, event_id, round(score, 6) as score from k join frames using (job_id, frame_idx, score)"))
def stream_keyframes(spark, sf):
    rows = keyframes.run_to_end(spark, smart_blur.event_scores(spark, sf), 40.0)
    return rounded(rows.select("job_id", "event_id", "score"), "score")


@query("""with recursive f as (select label as job_id, row_number() over (partition by label order by vec_id) - 1 as i, vec_id, embedding as e from embeddings),
k as (
  select job_id, i, vec_id, e as last, true as keep from f where i = 0
  union all
  select f.job_id, f.i, f.vec_id, case when m > 0.14 then f.e else k.last end, m > 0.14
  from k join f on f.job_id = k.job_id and f.i = k.i + 1,
    lateral (select list_sum(list_transform(range(1, 65), lambda x: abs(f.e[x]::double - k.last[x]::double))) / 64 as m))
select job_id, vec_id from k where keep""")
def adaptive_keyframes_raster(spark, sf):
    e = read_table(spark, sf, "embeddings").select(F.col("label").alias("job_id"), "vec_id", "embedding")
    return fr.adaptive_keyframes(e, 0.14, "embedding", order=("vec_id",)).select("job_id", "vec_id")


@query(f"with {FRAMES_SQL} select job_id, frame_idx, round(score, 6) as score from frames where score >= 100")
def blur_floor_filter(spark, sf):
    return rounded(fr.blur_floor(_frames(spark, sf), 100.0).select("job_id", "frame_idx", "score"), "score")


@query(f"with {FRAMES_SQL} select job_id, count(*) as n_frames, sum(case when score < 100 then 1 else 0 end)::bigint as n_skipped from frames group by job_id")
def skipped_blur_counts(spark, sf):
    return _frames(spark, sf).groupBy("job_id").agg(F.count("*").alias("n_frames"), F.count_if(F.col("score") < 100).alias("n_skipped"))


_SMART = f"""with recursive {FRAMES_SQL}, k as (
  select job_id, frame_idx, event_id, score, score >= 20 as keep, case when score >= 20 then [score] else []::double[] end as h, case when score >= 20 then 0 else 1 end as skips
  from frames where frame_idx = 0
  union all
  select f.job_id, f.frame_idx, f.event_id, f.score, g.keep, case when g.keep then list_append(k.h, f.score)[-10:] else k.h end, case when g.keep then 0 else k.skips + 1 end
  from k join frames f on f.job_id = k.job_id and f.frame_idx = k.frame_idx + 1,
    lateral (select not (f.score < 20 or (len(k.h) > 0 and f.score < 0.6::double * (list_sum(k.h) / len(k.h)))) or k.skips + 1 > 5 as keep) g)"""


@query(_SMART + " select job_id, frame_idx, round(score, 6) as score from k where keep")
def smart_blur_filter(spark, sf):
    return rounded(fr.smart_blur(_frames(spark, sf), 20.0, order=("frame_idx",)).select("job_id", "frame_idx", "score"), "score")


@query(_SMART + " select job_id, event_id, round(score, 6) as score from k where keep")
def stream_smart_blur(spark, sf):
    rows = smart_blur.run_available(spark, smart_blur.smart_blur_stream(smart_blur.event_scores(spark, sf), 20.0))
    return rounded(rows.select("job_id", "event_id", "score"), "score")


# --- rasters


@query("""with p as (select vec_id, i, embedding[i + 1]::double as z, embedding as e, i % 8 as x, i // 8 as y from embeddings, range(64) r(i)),
l as (select vec_id,
  e[y * 8 + (case when x = 0 then 1 else x - 1 end) + 1]::double + e[y * 8 + (case when x = 7 then 6 else x + 1 end) + 1]::double
  + e[(case when y = 0 then 1 else y - 1 end) * 8 + x + 1]::double + e[(case when y = 7 then 6 else y + 1 end) * 8 + x + 1]::double - 4 * z as lap from p)
select vec_id, round(var_pop(lap), 6) as blur_score from l group by vec_id""")
def laplacian_blur_score(spark, sf):
    return rounded(raster.laplacian_sql(read_table(spark, sf, "embeddings"), "embedding", 8, 8).select("vec_id", "blur_score"), "blur_score")


@query("""with p as (select vec_id, i % 8 as x, i // 8 as y, case when embedding[i + 1] > 0.1 then 255 else 0 end as m from embeddings, range(64) r(i))
select a.vec_id, a.x::int as x, a.y::int as y, 255 - max(b.m) as mask from p a join p b on a.vec_id = b.vec_id and abs(a.x - b.x) <= 1 and abs(a.y - b.y) <= 1 group by 1, 2, 3""")
def dilate_mask(spark, sf):
    m = F.transform("embedding", lambda v: F.when(v > F.lit(0.1).cast("float"), 255).otherwise(0))
    d = raster.dilated_sql(read_table(spark, sf, "embeddings").select("vec_id", m.alias("m")), "m", 8, 8, 3)
    p = d.select("vec_id", F.posexplode("m").alias("i", "v"))
    return p.select("vec_id", (F.col("i") % 8).alias("x"), F.floor(F.col("i") / 8).cast("int").alias("y"), (255 - F.col("v")).alias("mask"))


@query(f"""with {FRAMES_SQL}, m as (select job_id, case when count(*) > 60 then count(*) // 2 else 0 end as at from frames group by job_id),
v as (select f.job_id, i::int as view_idx, 'View_' || i as name, score / (i + 1) as score from frames f join m on f.job_id = m.job_id and f.frame_idx = m.at, range(6) r(i)),
a as (select job_id, avg(score) as average, min(score) as lo, max(score) as hi, string_agg(name || ':' || round(score, 3), ',' order by view_idx) as details from v group by job_id)
select job_id, round(average, 6) as average, round(lo, 6) as min, round(hi, 6) as max, round(average * 0.8, 6) as recommended, details from a""")
def blur_analysis(spark, sf):
    # The views of each job's middle frame; a view's score is a share of its frame's.
    f = fr.middle_frame(_frames(spark, sf))
    views = geometry.generate_views(spark, 6, 0.0)
    looks = f.crossJoin(F.broadcast(views.select("view_idx", "name"))).withColumn("score", F.col("score") / (F.col("view_idx") + 1))
    a = fr.blur_summary(looks, "job_id")
    details = F.array_join(F.transform("details", lambda x: F.concat(x["view"], F.lit(":"), ex.decimals(x["score"], 3).cast("string"))), ",")
    return rounded(a.select("job_id", "average", "min", "max", "recommended", details.alias("details")), "average", "min", "max", "recommended")


_PIXELS = "p as (select vec_id, i, i % 8 as x, i // 8 as y, greatest(0, least(255, floor(embedding[i + 1]::double * 256 + 128)))::int as v from embeddings, range(64) r(i))"


def _image(values, width, height, channels=1):
    """An image struct of an array of bytes."""
    data = F.unhex(F.array_join(F.transform(values, lambda v: F.lpad(F.hex(v.cast("long")), 2, "0")), ""))
    return F.struct(F.lit(height).alias("height"), F.lit(width).alias("width"), F.lit(channels).alias("channels"), data.alias("data"))


def _pictures(spark, sf):
    v = F.transform("embedding", lambda e: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(e.cast("double") * 256 + 128))))
    return read_table(spark, sf, "embeddings").select("vec_id", _image(v, 8, 8).alias("image"))


@query(f"""with {_PIXELS}, k as (select k, exp(-(k * k) / 8.0::double) as e from range(-7, 8) r(k)), w as (select k, e / (select sum(e) from k) as w from k),
t as (select c, k, w, case when c + k < 0 then -(c + k) when c + k > 7 then 14 - (c + k) else c + k end as src from w, range(8) r(c)),
h as (select vec_id, t.c as y, x, sum(w * v) as v from p join t on p.y = t.src group by 1, 2, 3),
g as (select vec_id, y, t.c as x, sum(w * v) as v from h join t on h.x = t.src group by 1, 2, 3)
select p.vec_id, string_agg(printf('%02X', greatest(0, least(255, round_even(p.v * 1.5::double - round_even(g.v, 0) * 0.5::double, 0)))::int), '' order by i) as pixels
from p join g on p.vec_id = g.vec_id and p.x = g.x and p.y = g.y group by p.vec_id""")
def sharpen_raster(spark, sf):
    out = raster.with_image_column(_pictures(spark, sf), "sharp", raster.IMAGE, lambda px: raster.sharpen(px, 0.5))
    return out.select("vec_id", F.hex("sharp.data").alias("pixels"))


@query(f"""with {_PIXELS}, g as (select j, floor(c)::int as a, least(floor(c)::int + 1, 7) as b, c - floor(c) as f from (select j, greatest(0::double, least(7::double, (j + 0.5::double) * 8 / 12 - 0.5::double)) as c from range(12) r(j))),
top as (select p.vec_id, p.x, p.y, greatest(p.v, q.v) / 255.0::double as v from p join p q on p.vec_id = q.vec_id and q.i = 63 - p.i),
big as (select n.vec_id, gx.j as x, gy.j as y, trunc(((a.v * (1 - gx.f) + b.v * gx.f) * (1 - gy.f) + (c.v * (1 - gx.f) + d.v * gx.f) * gy.f) * 255)::int as m
  from (select distinct vec_id from p) n, g gx, g gy, top a, top b, top c, top d
  where a.vec_id = n.vec_id and a.x = gx.a and a.y = gy.a and b.vec_id = n.vec_id and b.x = gx.b and b.y = gy.a and c.vec_id = n.vec_id and c.x = gx.a and c.y = gy.b and d.vec_id = n.vec_id and d.x = gx.b and d.y = gy.b),
wide as (select a.vec_id, a.x, a.y, 255 - max(b.m) as m from big a join big b on a.vec_id = b.vec_id and abs(a.x - b.x) <= 1 and abs(a.y - b.y) <= 1 group by 1, 2, 3)
select vec_id, string_agg(printf('%02X', m), '' order by y, x) as mask from wide group by vec_id""")
def feather_mask(spark, sf):
    # Two detections a view: the picture's values as probabilities, and the same from behind.
    pictures = read_table(spark, sf, "embeddings")
    prob = lambda e: (F.greatest(F.lit(0), F.least(F.lit(255), F.floor(e.cast("double") * 256 + 128))) / F.lit(255.0)).cast("double")
    one = F.transform("embedding", prob)
    found = pictures.select("vec_id", F.lit(8).alias("height"), F.lit(8).alias("width"), F.explode(F.array(one, F.reverse(one))).alias("prob"))
    views = pictures.select("vec_id", _image(F.array_repeat(F.lit(0), 144), 12, 12).alias("view_image"), F.lit("mask").alias("ai_action"))
    return det.with_table_masks(views, found, ["vec_id"], feather=True).select("vec_id", F.hex("mask.data").alias("mask"))


@query(f"""with {_PIXELS}, t as (select t from range(-3, 5) r(t)), axis as (select j, floor(0.35 + 1.7::double * j)::int as x0, (0.35 + 1.7::double * j) - floor(0.35 + 1.7::double * j) as fx,
  floor(0.6 + 1.3::double * j)::int as y0, (0.6 + 1.3::double * j) - floor(0.6 + 1.3::double * j) as fy from range(4) r(j)),
wx as (select j, (x0 + t + 8) % 8 as src, sin(pi() * (t - fx)) / (pi() * (t - fx)) * sin(pi() * (t - fx) / 4) / (pi() * (t - fx) / 4) as w from axis, t),
wy as (select j, (y0 + t + 8) % 8 as src, sin(pi() * (t - fy)) / (pi() * (t - fy)) * sin(pi() * (t - fy) / 4) / (pi() * (t - fy) / 4) as w from axis, t),
nx as (select j, src, w / sum(w) over (partition by j) as w from wx), ny as (select j, src, w / sum(w) over (partition by j) as w from wy),
o as (select vec_id, ny.j as y, nx.j as x, greatest(0, least(255, round_even(sum(ny.w * nx.w * v), 0)))::int as v from p join nx on p.x = nx.src join ny on p.y = ny.src group by 1, 2, 3)
select vec_id, string_agg(printf('%02X', v), '' order by y, x) as pixels from o group by vec_id""")
def remap_lanczos_small(spark, sf):
    def look(px):
        at = np.arange(4)
        u, v = np.broadcast_to(0.35 + 1.7 * at, (4, 4)), np.broadcast_to((0.6 + 1.3 * at)[:, None], (4, 4))
        return raster.remap(px, u, v, lanczos=True)

    out = raster.with_image_column(_pictures(spark, sf), "look", raster.IMAGE, look)
    return out.select("vec_id", F.hex("look.data").alias("pixels"))


class _Bright:
    """A detector that finds a class 0 thing, as sure as the image is bright."""

    def detect(self, images):
        return [[det.Detection(0, float(x.mean()) / 255)] for x in images]


@query(f"with {_PIXELS} select vec_id, case when avg(v) / 255 >= 0.5 then 'drop' else 'keep' end as ai_action from p group by vec_id")
def detector_skip(spark, sf):
    return det.with_detector(_pictures(spark, sf), _Bright, "skip_frame", 0.5, [0], image="image").select("vec_id", "ai_action")


@query("select bool_or(case o_orderkey % 3 when 0 then 'None' when 1 then null else case when o_orderstatus = 'F' then 'Skip Frame' else 'None' end end = 'Skip Frame') as needs_detector from orders")
def any_needs_detector(spark, sf):
    k = F.col("o_orderkey") % 3
    mode = F.when(k == 0, "None").when(k == 2, F.when(F.col("o_orderstatus") == "F", "Skip Frame").otherwise("None"))
    return jobs.any_needs_detector(read_table(spark, sf, "orders").select(mode.alias("ai_mode")))


@query("""with m as (select '/in/' || (c_custkey % 7) || '/' || c_name || '.MP4' as path, '/in/' || (c_custkey % 7) || '/' || c_name as stem from customer),
f as (select '/in/' || (c_custkey % 7) || '/' || c_name || case c_custkey % 3 when 0 then '.gpx' when 1 then '.GPX' else '.srt' end as path, '/in/' || (c_custkey % 7) || '/' || c_name as stem, c_custkey % 3 < 2 as ok from customer)
select m.path, f.path as sidecar_path from m left join f on m.stem = f.stem and f.ok""")
def media_sidecars(spark, sf):
    c = read_table(spark, sf, "customer")
    at = F.concat(F.lit("/in/"), (F.col("c_custkey") % 7).cast("string"), F.lit("/"), F.col("c_name"))
    k = F.col("c_custkey") % 3
    files = c.select(F.concat(at, F.when(k == 0, ".gpx").when(k == 1, ".GPX").otherwise(".srt")).alias("path"))
    return media.with_sidecars(c.select(F.concat(at, F.lit(".MP4")).alias("path")), files).select("path", "sidecar_path")


# --- telemetry


@query(f"with {ALL_SAMPLES_SQL} select job_id, seq, round(ts, 6) as ts, round(lat, 6) as lat, round(lon, 6) as lon, round(alt, 6) as alt from clean")
def telemetry_sanitize(spark, sf):
    s = tel.sanitized(ex.event_samples(_events(spark, sf)))
    return rounded(s.select("job_id", "seq", "ts", "lat", "lon", "alt"), "ts", "lat", "lon", "alt")


_INTERPOLATED = f"""{SAMPLES_SQL},
q as (select user_id as job_id, event_id, epoch_us(ts) / 1e6 - 1704067200 as t from events where event_id % 3 <> 0),
a as (select q.*, c.ts as t1, c.lat as lat1, c.lon as lon1, c.alt as alt1 from q asof left join clean c on q.job_id = c.job_id and q.t > c.ts),
b as (select a.*, c.ts as t2, c.lat as lat2, c.lon as lon2, c.alt as alt2 from a asof left join clean c on a.job_id = c.job_id and a.t <= c.ts),
w as (select *, case when t1 is not null and t2 > t1 then (t - t1) / (t2 - t1) else 0 end as f from b),
x as (select *, coalesce(lat1, lat2) as a1, coalesce(lat2, lat1) as a2, coalesce(lon1, lon2) as o1, coalesce(lon2, lon1) as o2, coalesce(alt1, alt2) as h1, coalesce(alt2, alt1) as h2 from w)"""


@query(f"with {_INTERPOLATED} select job_id, event_id, round(a1 + (a2 - a1) * f, 6) as lat, round(o1 + (o2 - o1) * f, 6) as lon, round(h1 + (h2 - h1) * f, 6) as alt from x")
def telemetry_interpolate(spark, sf):
    e = _events(spark, sf)
    samples = tel.sanitized(ex.event_samples(e).where("seq % 3 = 0"))
    q = ex.event_frames(e).where("event_id % 3 <> 0").select("job_id", "t", "event_id")
    return rounded(tel.interpolated(q, samples).select("job_id", "event_id", "lat", "lon", "alt"), "lat", "lon", "alt")


@query(SQL["telemetry_interpolate"])
def telemetry_interpolate_long(spark, sf):
    # Jobs of more than 25 rows are cut.
    e = _events(spark, sf)
    samples = tel.sanitized(ex.event_samples(e).where("seq % 3 = 0"))
    q = ex.event_frames(e).where("event_id % 3 <> 0").select("job_id", "t", "event_id")
    return rounded(tel.interpolated_long(q, samples, 25).select("job_id", "event_id", "lat", "lon", "alt"), "lat", "lon", "alt")


@query("""with s as (select l_orderkey as media_id, l_linenumber as stream_index, case when l_linenumber = 1 then 'sidecar' when l_returnflag = 'A' then 'subtitle' else 'data' end as kind,
  case when l_partkey % 3 = 0 then 'gpmd' when l_partkey % 3 = 1 then 'CAMM x' else 'other' end as tag, l_suppkey % 4 as samples from lineitem),
r as (select *, case when kind = 'sidecar' and samples > 0 then 0 when kind = 'data' and (lower(tag) like '%gpmd%' or lower(tag) like '%camm%') then 1 when kind = 'subtitle' then 2 end as rk from s),
n as (select *, row_number() over (partition by media_id order by rk, stream_index, kind, tag) as n from r where rk is not null)
select media_id, kind, tag, stream_index from n where n = 1""")
def telemetry_source_priority(spark, sf):
    p = F.col("l_partkey") % 3
    s = read_table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("media_id"), F.col("l_linenumber").alias("stream_index"),
        F.when(F.col("l_linenumber") == 1, "sidecar").when(F.col("l_returnflag") == "A", "subtitle").otherwise("data").alias("kind"),
        F.when(p == 0, "gpmd").when(p == 1, "CAMM x").otherwise("other").alias("tag"), (F.col("l_suppkey") % 4).alias("samples"),
    )
    return tel.chosen_tracks(s).select("media_id", "kind", "tag", "stream_index")


@query(f"""with {ALL_SAMPLES_SQL}, n as (select *, row_number() over (partition by job_id order by seq) - 1 as i, count(*) over (partition by job_id) as n from clean)
select job_id, seq, round(case when job_id % 3 > 0 then i / n::double * (job_id % 3 * 10) else i * 0.2::double end, 6) as ts from n""")
def camm_even_timestamps(spark, sf):
    s = tel.sanitized(ex.event_samples(_events(spark, sf)))
    return rounded(tel.even_timestamps(s, F.col("job_id") % 3 * 10).select("job_id", "seq", "ts"), "ts")


@query(f"with {ALL_SAMPLES_SQL} select job_id, seq, round((row_number() over (partition by job_id order by seq) - 1) / 18.0::double, 6) as ts from clean")
def gpmf_clock(spark, sf):
    s = tel.sanitized(ex.event_samples(_events(spark, sf)))
    return rounded(tel.clock_timestamps(s).select("job_id", "seq", "ts"), "ts")


def _written(spark, sf):
    """Samples with values that their formats hold exactly, and a running number."""
    s = tel.sanitized(ex.event_samples(_events(spark, sf)))
    n = F.row_number().over(Window.partitionBy("job_id").orderBy("seq")) - 1
    return s.withColumns({"n": n, "alt": F.round("alt", 1)})


_WRITTEN = """all_s as (select user_id as job_id, event_id as seq, (event_id * 37 % 2000) / 10.0::double - 100 as lat, (event_id * 53 % 4000) / 10.0::double - 200 as lon, round(value, 1) as alt from events),
w as (select *, row_number() over (partition by job_id order by seq) - 1 as n, count(*) over (partition by job_id) as m from all_s where lat between -90 and 90 and lon between -180 and 180)"""


#: Samples of a part of a job's payload.
CHUNK = 3000


def _parts(w, chunk, between=""):
    """(job_id, part, m, parts): a job's chunks of text in order, joined in parts of CHUNK of them, so that no row has a whole job."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", chunk.alias("b")))), lambda x: x["b"]), between)
    return w.groupBy("job_id", F.floor(F.col("n") / CHUNK).cast("int").alias("part")).agg(F.count("*").alias("m"), joined.alias("parts"))


def _srt(spark, sf):
    num = lambda c: F.format_string("%.1f", F.col(c))
    time = F.concat(F.lit("00:"), F.format_string("%02d:%02d,500", (F.col("n") / 60).cast("int"), (F.col("n") % 60).cast("int")))
    body = F.concat(F.lit("[latitude: "), num("lat"), F.lit("] [longitude: "), num("lon"), F.lit("] [rel_alt: 1.5 abs_alt: "), num("alt"), F.lit("]"))
    body = F.when(F.col("n") % 2 == 0, body).otherwise(F.concat(F.lit("GPS("), num("lat"), F.lit(", "), num("lon"), F.lit(", "), num("alt"), F.lit(")")))
    block = F.concat(F.col("n").cast("string"), F.lit("\r\n"), time, F.lit(" --> 00:00:00,000\r\n"), body)
    w = _parts(_written(spark, sf), block, "\r\n\r\n")
    return w.select("job_id", "part", F.encode("parts", "UTF-8").alias("content"))


def _srt_samples(files, mode):
    s = tracks.parse_srt(files, mode, part="part")
    seq = F.floor(F.col("seq") / tracks.PART) * CHUNK + F.pmod(F.col("seq"), F.lit(tracks.PART))
    return rounded(s.withColumn("seq", seq.cast("long")), "ts", "lat", "lon", "alt")


@query(f"with {_WRITTEN} select job_id, n as seq, round(n + 0.5::double, 6) as ts, round(lat, 6) as lat, round(lon, 6) as lon, alt from w")
def parse_srt_absolute(spark, sf):
    return _srt_samples(_srt(spark, sf), "absolute")


@query(f"with {_WRITTEN} select job_id, n as seq, round(n + 0.5::double, 6) as ts, round(lat, 6) as lat, round(lon, 6) as lon, case when n % 2 = 0 then 1.5::double else alt end as alt from w")
def parse_srt_relative(spark, sf):
    return _srt_samples(_srt(spark, sf), "relative")


def _packed(w, chunk, head="", tail=""):
    """One payload a job from hexadecimal chunks in order."""
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", chunk.alias("b")))), lambda x: x["b"]), "")
    return w.groupBy("job_id").agg(F.count("*").alias("m"), parts.alias("parts"))


@query(f"with {_WRITTEN} select job_id, n as seq, round(n * 2.0::double, 6) as ts, round(lat, 6) as lat, round(lon, 6) as lon, alt from w")
def parse_gpx(spark, sf):
    time = F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("n") * 2), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    point = F.format_string('<trkpt lat="%.1f" lon="%.1f"><ele>%.1f</ele><time>%s</time></trkpt>', "lat", "lon", "alt", time)
    p = _packed(_written(spark, sf), point)
    whole = F.concat(F.lit('<gpx xmlns="http://www.topografix.com/GPX/1/1"><trk><trkseg>'), "parts", F.lit("</trkseg></trk></gpx>"))
    return rounded(tracks.parse_tracks(p.select("job_id", F.encode(whole, "UTF-8").alias("content")), "gpx"), "ts", "lat", "lon", "alt")


def _be32(x):
    """Eight hexadecimal digits of a signed 32-bit number."""
    return F.lpad(F.hex(F.pmod(x.cast("long"), F.lit(1 << 32))), 8, "0")


@query(f"with {_WRITTEN} select job_id, n as seq, round(n / 18.0::double, 6) as ts, round(lat, 6) as lat, round(lon, 6) as lon, alt from w")
def parse_gpmf(spark, sf):
    # A block's count of samples has 16 bits, so a job is as many DEVC blocks as it needs, each a part of its payload.
    row = F.concat(*(_be32(F.round(F.col(c) * 10)) for c in ("lat", "lon", "alt")), F.lit("00000000" * 2))
    p = _parts(_written(spark, sf), row)
    h = lambda text: F.lit(text.encode().hex().upper())
    scal = F.concat(h("SCAL"), h("l"), F.lit("040005"), F.lit("0000000A" * 3 + "00000001" * 2))
    gps5 = F.concat(h("GPS5"), h("l"), F.lit("14"), F.lpad(F.hex("m"), 4, "0"), "parts")
    # Nested levels give their size as size 4 and a count of words.
    level = lambda key, body: F.concat(h(key), F.lit("0004"), F.lpad(F.hex((F.length(body) / 8).cast("long")), 4, "0"), body)
    files = p.select("job_id", "part", F.unhex(level("DEVC", level("STRM", F.concat(scal, gps5)))).alias("payload"))
    return rounded(tracks.parse_parts(files, "gpmf"), "ts", "lat", "lon", "alt")


@query(f"with {_WRITTEN} select job_id, n as seq, round(n / m::double * 30, 6) as ts, round(lat, 6) as lat, round(lon, 6) as lon, round(alt, 3) as alt from w")
def parse_camm(spark, sf):
    return _camm(_written(spark, sf))


@query(f"""with {_WRITTEN}, k as (select *, row_number() over (partition by job_id order by n) - 1 as i, count(*) over (partition by job_id) as found from w where n % 5 > 0)
select job_id, i as seq, round(i / found::double * 30, 6) as ts, round(lat, 6) as lat, round(lon, 6) as lon, round(alt, 3) as alt from k""")
def camm_null_island(spark, sf):
    # Every fifth packet has no fix: latitude and longitude zero.
    fix = lambda c: F.when(F.col("n") % 5 > 0, F.col(c)).otherwise(F.lit(0.0))
    return _camm(_written(spark, sf).withColumns({"lat": fix("lat"), "lon": fix("lon")}))


def _camm(w):
    """The samples that are read back from packets written for w."""

    def double_le(c):
        # IEEE bits of a double, exact for these values: sign, exponent and fraction from arithmetic.
        a = F.abs(F.col(c))
        e = F.floor(F.log2(F.when(a == 0, 1.0).otherwise(a)))
        e = F.when(F.pow(F.lit(2.0), e) > a, e - 1).when(F.pow(F.lit(2.0), e + 1) <= a, e + 1).otherwise(e)
        bits = ((e + 1023).cast("long") * F.lit(1 << 52)) + ((a / F.pow(F.lit(2.0), e) - 1) * F.lit(float(1 << 52))).cast("long")
        big = F.concat(F.when(F.col(c) < 0, F.hex(F.lit(8) + F.floor(bits / F.lit(1 << 60)))).otherwise(F.hex(F.floor(F.shiftright(bits, 60)))), F.substring(F.lpad(F.hex(bits), 16, "0"), 2, 15))
        big = F.when(a == 0, F.lit("0" * 16)).otherwise(big)
        return F.concat(*(F.substring(big, i, 2) for i in range(15, 0, -2)))

    def float_le(c):
        a = F.col(c)
        e = F.floor(F.log2(a))
        e = F.when(F.pow(F.lit(2.0), e) > a, e - 1).when(F.pow(F.lit(2.0), e + 1) <= a, e + 1).otherwise(e)
        frac = F.bround((a / F.pow(F.lit(2.0), e) - 1) * F.lit(float(1 << 23))).cast("long")
        big = F.when(a <= 0, F.lit("0" * 8)).otherwise(F.lpad(F.hex((e + 127).cast("long") * F.lit(1 << 23) + frac), 8, "0"))
        return F.concat(*(F.substring(big, i, 2) for i in range(7, 0, -2)))

    p = _parts(w, F.concat(F.lit("00000600"), double_le("lat"), double_le("lon"), float_le("alt")))
    files = p.select("job_id", "part", F.unhex("parts").alias("payload"), F.lit(30.0).alias("duration"))
    return rounded(rounded(tracks.parse_parts(files, "camm", duration="duration"), "ts", "lat", "lon"), "alt", digits=3)


@query(f"""with {ALL_SAMPLES_SQL}, d as (select *, abs(lat) as x, abs(lon) as y from clean)
select job_id, seq, case when lat >= 0 then 'N' else 'S' end as lat_ref, floor(x)::bigint as lat_deg, floor((x - floor(x)) * 60)::bigint as lat_min,
  trunc((x - floor(x) - floor((x - floor(x)) * 60) / 60) * 3600 * 1000000)::bigint as lat_sec_num, case when lon >= 0 then 'E' else 'W' end as lon_ref, floor(y)::bigint as lon_deg,
  case when alt >= 0 then 0 else 1 end as alt_ref, trunc(abs(alt) * 1000000)::bigint as alt_num from d""")
def exif_dms(spark, sf):
    s = tel.sanitized(ex.event_samples(_events(spark, sf)))
    g = s.select("job_id", "seq", gps.gps_tags(F.col("lat"), F.col("lon"), F.col("alt")).alias("g"))
    whole = lambda c: (F.col(f"{c}.num") / 1_000_000).cast("long")
    return g.select(
        "job_id", "seq", F.col("g.lat_ref").alias("lat_ref"), whole("g.lat.deg").alias("lat_deg"), whole("g.lat.min").alias("lat_min"), F.col("g.lat.sec.num").alias("lat_sec_num"),
        F.col("g.lon_ref").alias("lon_ref"), whole("g.lon.deg").alias("lon_deg"), F.col("g.alt_ref").alias("alt_ref"), F.col("g.alt.num").alias("alt_num"),
    )


# --- names and outputs


def _named(spark, sf, mode, ext="jpg", image=None, mask=None):
    f = _frames(spark, sf)
    i, m = naming.output_names(mode, F.concat(F.lit("clip"), F.col("job_id")), F.col("frame_idx") * 100_003, F.col("face"), ext, image, mask)
    return f.select("job_id", "frame_idx", i.alias("image_name"), m.alias("mask_name"))


_N = "'clip' || job_id || '_frame' || printf('%06d', frame_idx * 100003) || '_' || face"


@query(f"with {FRAMES_SQL} select job_id, frame_idx, {_N} || '.jpg' as image_name, {_N} || '.jpg.mask.png' as mask_name from frames")
def naming_realityscan(spark, sf):
    return _named(spark, sf, "realityscan")


@query(f"with {FRAMES_SQL} select job_id, frame_idx, {_N} || '.tif' as image_name, {_N} || '_mask.png' as mask_name from frames")
def naming_simple(spark, sf):
    return _named(spark, sf, "simple", "tif")


@query(f"with {FRAMES_SQL} select job_id, frame_idx, face || '-' || printf('%06d', frame_idx * 100003) || '.png' as image_name, 'm_' || face || '-' || printf('%06d', frame_idx * 100003) || '.png' || '.x.png' as mask_name from frames")
def naming_custom(spark, sf):
    return _named(spark, sf, "custom", "png", "{camera}-{frame}", "m_{image_name}.x.{ext}")


@query(f"with {FRAMES_SQL} select job_id, frame_idx, printf('%06d', frame_idx * 100003) || '.jpg' as image_name, face || '_m.png' as mask_name from frames")
def naming_confinement(spark, sf):
    return _named(spark, sf, "custom", "jpg", "../../etc/{filename}/{frame}", "/tmp/../{camera}_m")


_PATHS = "select o_orderkey as job_id, case when o_orderkey % 3 = 0 then '/in/' else '/media/' || o_orderpriority || '/' end || 'c' || o_custkey % 50 || case when o_orderkey % 2 = 0 then '.v2.mp4' else '.JPG' end as file_path, case when o_orderkey % 5 = 0 then '/out/' else ' ' end as custom_dir from orders"
_OUT = "case when trim(custom_dir) <> '' then '/out' else regexp_extract(file_path, '^(.*)/[^/]*$', 1) end || '/' || regexp_replace(regexp_extract(file_path, '[^/]*$'), '\\.[^.]*$', '') || '_processed'"


def _jobs(spark, sf):
    o = read_table(spark, sf, "orders")
    k = F.col("o_orderkey")
    path = F.concat(F.when(k % 3 == 0, F.lit("/in/")).otherwise(F.concat(F.lit("/media/"), F.col("o_orderpriority"), F.lit("/"))), F.lit("c"), (F.col("o_custkey") % 50).cast("string"), F.when(k % 2 == 0, ".v2.mp4").otherwise(".JPG"))
    return o.select(k.alias("job_id"), path.alias("file_path"), F.when(k % 5 == 0, "/out/").otherwise(" ").alias("custom_dir"), "o_orderstatus", "o_totalprice", "o_custkey")


@query(f"with j as ({_PATHS}) select job_id, {_OUT} as output_dir from j")
def output_dirs(spark, sf):
    return _jobs(spark, sf).select("job_id", naming.output_dir(F.col("file_path"), F.col("custom_dir")).alias("output_dir"))


@query(f"with j as ({_PATHS}), o as (select job_id, {_OUT} as output_dir from j) select job_id, output_dir, count(*) over (partition by output_dir) as n_same from o")
def output_collisions(spark, sf):
    return jobs.collisions(output_dirs(spark, sf)).select("job_id", "output_dir", "n_same")


@query("""select p_partkey as job_id, case when lower(split_part(p_type, ' ', 1)) in ('jpg', 'png', 'tiff') then 'x' else 'jpg' end as format,
  case when p_partkey % 4 = 0 then 'tif' when p_partkey % 4 = 1 then 'png' else 'jpg' end as suffix from part""")
def output_formats(spark, sf):
    p = read_table(spark, sf, "part")
    k = F.col("p_partkey") % 4
    wanted = F.when(k == 0, "TIFF").when(k == 1, " png").when(k == 2, "JPG").otherwise("webp")
    return p.select(F.col("p_partkey").alias("job_id"), naming.file_format(F.col("p_type"))[0].alias("format"), naming.file_format(wanted)[1].alias("suffix"))


@query("""select page_id, regexp_extract(url, '[^/]*$') as file_name, lower(regexp_extract(url, '[^/]*\\.([^./]*)$', 1)) as suffix from
  (select page_id, split_part(split_part(url, '?', 1), '#', 1) || case page_id % 4 when 0 then '.MP4' when 1 then '.tif' when 2 then '.gif' else '' end as url from pages) p where page_id % 4 in (0, 1)""")
def media_scan_filter(spark, sf):
    k = F.col("page_id") % 4
    url = F.concat(F.regexp_extract("url", "^[^?#]*", 0), F.when(k == 0, ".MP4").when(k == 1, ".tif").when(k == 2, ".gif").otherwise(""))
    p = read_table(spark, sf, "pages").select("page_id", url.alias("path")).where(naming.is_media(F.col("path")))
    return p.select("page_id", naming.basename(F.col("path")).alias("file_name"), naming.suffix(F.col("path")).alias("suffix"))


# --- settings and jobs


@query("""select c_custkey as job_id, coalesce(case when c_custkey % 2 = 0 then c_nationkey * 256 end, case when c_custkey % 3 = 0 then 1024 end, 2048)::int as resolution,
  coalesce(case when c_custkey % 7 = 0 then 'cube' end, case when c_acctbal > 0 then 'fibonacci' end, 'ring') as layout_mode from customer""")
def settings_merge(spark, sf):
    k = F.col("c_custkey")
    c = read_table(spark, sf, "customer").select(
        k.alias("job_id"), F.when(k % 2 == 0, F.col("c_nationkey") * 256).alias("cli_res"), F.when(k % 3 == 0, 1024).alias("cfg_res"),
        F.when(k % 7 == 0, "cube").alias("cli_layout"), F.when(F.col("c_acctbal") > 0, "fibonacci").alias("cfg_layout"),
    )
    d = settings.DEFAULTS
    m = settings.merged_columns(c, {"resolution": ("cli_res", "cfg_res", d["resolution"]), "layout_mode": ("cli_layout", "cfg_layout", d["layout_mode"])})
    return m.select("job_id", "resolution", "layout_mode")


@query("""select c_custkey as job_id, case when c_custkey % 5 = 0 then 'Skip Frame' when c_custkey % 5 = 1 then 'Generate Mask'
  when c_custkey % 3 = 0 then 'Skip Frame' when c_nationkey % 2 = 0 then 'Generate Mask' else 'None' end as ai_mode from customer""")
def ai_mode_resolution(spark, sf):
    k = F.col("c_custkey")
    mode = settings.ai_mode_column(k % 5 == 0, k % 5 == 1, F.when(k % 3 == 0, "Skip Frame").when(k % 3 == 1, "None"), F.col("c_nationkey") % 2 == 0)
    return read_table(spark, sf, "customer").select(k.alias("job_id"), mode.alias("ai_mode"))


@query("""select c_custkey as job_id, case when t = '' then '0' else t end as class_ids from (select c_custkey, concat_ws(',', case when c_custkey % 2 = 0 then '0' end,
  case when c_custkey % 3 = 0 then '2,3,4,5,6,7,8' end, case when c_custkey % 7 = 0 then '16' end, case when c_custkey % 5 = 0 then '58' end) as t from customer) x""")
def target_resolution(spark, sf):
    k = F.col("c_custkey")
    ids = det.targets(k % 2 == 0, k % 3 == 0, k % 5 == 0, F.when(k % 7 == 0, F.array(F.lit(16))))
    return read_table(spark, sf, "customer").select(k.alias("job_id"), F.array_join(ids.cast("array<string>"), ",").alias("class_ids"))


@query("""select o_orderkey as job_id, floor(x * 100 / n)::int as percent,
  case when x > 0 then floor(floor((n - x) / (x / e)) / 60)::bigint || 'm ' || (floor((n - x) / (x / e))::bigint % 60) || 's' else '--m --s' end as eta
  from (select o_orderkey, o_custkey % 97 as x, 97 + o_orderkey % 1000 as n, 1.5::double + o_orderkey % 13 as e from orders) o""")
def job_progress_eta(spark, sf):
    x, n, e = F.col("o_custkey") % 97, F.lit(97) + F.col("o_orderkey") % 1000, F.lit(1.5) + F.col("o_orderkey") % 13
    percent, eta = jobs.progress(x, n, e)
    return read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("job_id"), percent.alias("percent"), eta.alias("eta"))


@query("select s_suppkey as job_idx, floor((s_suppkey * 100 + s_nationkey * 4) / count(*) over ())::int as batch_percent from supplier")
def batch_progress(spark, sf):
    s = read_table(spark, sf, "supplier").select(F.col("s_suppkey").alias("job_idx"), (F.col("s_nationkey") * 4).alias("percent"))
    return jobs.batch_progress(s, "job_idx", "percent").select("job_idx", "batch_percent")


@query("""with s as (select case o_orderstatus when 'F' then 'Done' when 'O' then 'Error' else 'Pending' end as status from orders)
select count(*) as n_jobs, count_if(status = 'Error')::bigint as n_errors, count_if(status = 'Pending')::bigint as n_pending,
  case when count_if(status = 'Pending') > 0 then 'cancelled' when count_if(status = 'Error') > 0 then 'errors' else 'success' end as outcome from s""")
def batch_outcome(spark, sf):
    status = F.when(F.col("o_orderstatus") == "F", "Done").when(F.col("o_orderstatus") == "O", "Error").otherwise("Pending")
    return jobs.outcome(read_table(spark, sf, "orders").select(status.alias("status")))


@query("""select c_custkey as job_id, case when c_custkey % 11 = 0 then 'Flat (Non-360)' else case c_nationkey % 3 when 0 then 'High (-20°)' when 1 then 'Low (20°)' else 'Std (0°)' end
  || ', ' || (c_custkey % 34 + 2) || ' cams' || case c_custkey % 4 when 0 then ' (Ring)' when 1 then ' (Cube)' when 2 then ' (Fibonacci)' else '' end end
  || case when c_custkey % 2 = 0 then ' [Adaptive]' else '' end || case c_custkey % 3 when 0 then ' [AI Mask]' when 1 then ' [AI Skip]' else '' end as summary from customer""")
def job_summary(spark, sf):
    k, n = F.col("c_custkey"), F.col("c_nationkey") % 3
    pick = lambda c, *xs: F.element_at(F.array(*map(F.lit, xs)), (c + 1).cast("int"))
    text = jobs.summary(k % 11 != 0, pick(n, -20, 20, 0), k % 34 + 2, pick(k % 4, "ring", "cube", "fibonacci", "adaptive"), k % 2 == 0, pick(k % 3, "Generate Mask", "Skip Frame", "None"))
    return read_table(spark, sf, "customer").select(k.alias("job_id"), text.alias("summary"))


# --- detections


def _detections(spark, sf):
    """Detections from events, one each, with a class and a confidence."""
    f = _frames(spark, sf)
    return f.select("job_id", "frame_idx", "face", (F.col("event_id") % 80).cast("int").alias("class_id"), (F.col("score") / 500).alias("conf"), (F.col("event_id") % 8 == 0).alias("has_mask"))


_DETECTIONS = "d as (select job_id, frame_idx, face, (event_id % 80)::int as class_id, score / 500 as conf, event_id % 8 = 0 as has_mask from frames)"


@query(f"with {FRAMES_SQL} select job_id, frame_idx, face from frames where job_id % 3 = 0 or (job_id % 3 = 1 and face in ('click', 'view'))")
def mask_face_scope(spark, sf):
    k = F.col("job_id") % 3
    scope = det.face_scope(F.when(k == 0, " , ").when(k == 1, " Click, VIEW ,click").otherwise("none such"))
    return _frames(spark, sf).where(det.in_scope(F.col("face"), scope)).select("job_id", "frame_idx", "face")


@query(f"with {FRAMES_SQL}, {_DETECTIONS} select job_id, frame_idx, face, class_id, round(conf, 6) as conf from d where conf >= 0.25 and class_id in (0, 4, 8, 16, 32)")
def detections_filter(spark, sf):
    found = det.confident(_detections(spark, sf), [0, 4, 8, 16, 32], 0.25)
    return rounded(found.select("job_id", "frame_idx", "face", "class_id", "conf"), "conf")


@query(f"with {FRAMES_SQL}, {_DETECTIONS} select job_id, frame_idx, face from frames f where not exists (select 1 from d where d.job_id = f.job_id and d.frame_idx = f.frame_idx and d.face = f.face and conf >= 0.25)")
def skip_views_anti(spark, sf):
    found = det.confident(_detections(spark, sf), None, 0.25)
    return det.without_detections(_frames(spark, sf), found, ["job_id", "frame_idx", "face"]).select("job_id", "frame_idx", "face")


@query(f"""with {FRAMES_SQL}, {_DETECTIONS}, h as (select job_id, frame_idx, face, count(*) as n, count_if(has_mask) as m from d where conf >= 0.25 group by 1, 2, 3)
select f.job_id, f.frame_idx, f.face, case when f.face <> 'view' then 'pass' when coalesce(m, 0) > 0 then 'mask' else 'empty_mask' end as ai_action
from frames f left join h on h.job_id = f.job_id and h.frame_idx = f.frame_idx and h.face = f.face""")
def ai_outcome(spark, sf):
    found = det.confident(_detections(spark, sf), None, 0.25)
    out = det.outcomes(_frames(spark, sf), found, ["job_id", "frame_idx", "face"], "generate_mask", F.col("face") == "view")
    return out.select("job_id", "frame_idx", "face", "ai_action")


@query("""with n as (select distinct p_partkey, lower(trim(unnest(string_split('Car, ' || case when p_partkey % 2 = 0 then 'potted plant' else 'lamp' end || ',,' || case p_partkey % 3 when 0 then ' DOG' when 1 then 'car' else 'toothbrush ' end, ',')))) as name from part)
select p_partkey as job_id, c.id as class_id from n join (values (2, 'car'), (16, 'dog'), (58, 'potted plant'), (79, 'toothbrush')) c(id, name) on n.name = c.name""")
def class_name_lookup(spark, sf):
    k = F.col("p_partkey")
    text = F.concat(F.lit("Car, "), F.when(k % 2 == 0, "potted plant").otherwise("lamp"), F.lit(",,"), F.when(k % 3 == 0, " DOG").when(k % 3 == 1, "car").otherwise("toothbrush "))
    names = read_table(spark, sf, "part").select(k.alias("job_id"), text.alias("classes"))
    return det.class_ids(names, det.class_table(spark), "job_id", "classes")


# --- end to end


@query(f"""with {FRAMES_SQL}, {SAMPLES_SQL},
q as (select * from frames where frame_idx % 2 = 0 and score >= 50),
a as (select q.*, c.ts as t1, c.lat as lat1, c.lon as lon1, c.alt as alt1 from q asof left join clean c on q.job_id = c.job_id and q.t > c.ts),
b as (select a.*, c.ts as t2, c.lat as lat2, c.lon as lon2, c.alt as alt2 from a asof left join clean c on a.job_id = c.job_id and a.t <= c.ts),
w as (select *, case when t1 is not null and t2 > t1 then (t - t1) / (t2 - t1) else 0 end as f from b),
x as (select *, coalesce(lat1, lat2) as a1, coalesce(lat2, lat1) as a2, coalesce(lon1, lon2) as o1, coalesce(lon2, lon1) as o2, coalesce(alt1, alt2) as h1, coalesce(alt2, alt1) as h2 from w),
n as (select *, 'job' || job_id || '_frame' || printf('%06d', frame_idx) || '_View_' || i || '.jpg' as image_name from x, range(6) r(i))
select job_id, frame_idx, i::int as view_idx, i * 60.0::double as yaw, -20.0::double as pitch, round(t, 6) as t, round(score, 6) as score, round(a1 + (a2 - a1) * f, 6) as lat, round(o1 + (o2 - o1) * f, 6) as lon,
  round(h1 + (h2 - h1) * f, 6) as alt, image_name, image_name || '.mask.png' as mask_name from n""")
def end_to_end_extraction(spark, sf):
    return ex.flagship(spark, sf)
