"""Registered queries over files of many kinds that Spark writes of the tables' rows and reads back, and their DuckDB SQL."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from orbitframe.functions import naming, raster
from orbitframe.operators import detections as det, frames as fr
from orbitframe.plans import settings
from orbitframe.plans.queries import _PIXELS, _WRITTEN, _image, _pictures, _written, query, rounded
from orbitframe.session import ensure_checkpoint_dir, read_table, written_table
from orbitframe.sources import containers, jpeg, media, rawvideo, sinks, tracks
from orbitframe.sources.stores import located

#: Vectors that are the rows of one picture.
ROWS = 64


def new_folder(spark: SparkSession) -> str:
    """A folder of its own in the shared one."""
    return f"{ensure_checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"


def key_of(path: str = "path"):
    """The number that a file is named by."""
    return naming.stem(F.col(path)).cast("long")


# --- images


def _mosaics(spark, sf) -> DataFrame:
    """(picture, image): ROWS vectors, as bytes, are the rows of a picture; its rows without a vector are black."""
    v = F.transform("embedding", lambda e: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(e.cast("double") * 256 + 128))).cast("int"))
    e = read_table(spark, sf, "embeddings").select((F.col("vec_id") / ROWS).cast("long").alias("picture"), (F.col("vec_id") % ROWS).cast("int").alias("y"), v.alias("v"))
    rows = e.groupBy("picture").agg(F.map_from_entries(F.collect_list(F.struct("y", "v"))).alias("rows"))  # ROWS of them at most
    black = F.array_repeat(F.lit(0), 64)
    flat = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(ROWS - 1)), lambda y: F.coalesce(F.element_at("rows", y), black)))
    return rows.select("picture", _image(flat, 64, ROWS).alias("view_image"))


def written_images(images: DataFrame, folder: str, ext, quality: int = 95, more: tuple[str, ...] = ()) -> None:
    """Writes images (picture, view_image) under their numbers, by the two steps of the sinks; ``ext`` is a column."""
    files = images.select(F.lit(folder).alias("output_dir"), ext.alias("ext"), F.concat(F.col("picture").cast("string"), F.lit("."), ext).alias("image_name"), "view_image", *more)
    staged = written_table(sinks.staged(sinks.encoded(files, quality=quality, ext_col="ext").drop("view_image", *more), "q"))
    failed = sinks.published(staged.withColumn("keep", F.lit(True))).where("not ok").first()
    if failed:
        raise OSError(f"{failed.path}: {failed.error}")
    sinks.cleared(staged, "q").write.format("noop").mode("overwrite").save()


def _picture_rows(frames: DataFrame) -> DataFrame:
    """(vec_id, pixels): the rows of the pictures in hexadecimal digits."""
    at = F.sequence(F.lit(0), F.col("image.height") - 1)
    r = frames.select(key_of().alias("picture"), F.posexplode(F.transform(at, lambda y: F.hex(F.substring(F.col("image.data"), y * F.col("image.width") + 1, F.col("image.width"))))).alias("y", "pixels"))
    return r.select((F.col("picture") * ROWS + F.col("y")).alias("vec_id"), "pixels")


@query(f"with {_PIXELS} select vec_id, string_agg(printf('%02X', v), '' order by i) as pixels from p group by vec_id")
def stills_lossless(spark, sf):
    # Every other picture is a TIFF, the others are PNGs; the image source reads both.
    folder = new_folder(spark)
    written_images(_mosaics(spark, sf), folder, F.when(F.col("picture") % 2 == 0, "png").otherwise("tif"))
    rows = _picture_rows(media.still_frames(spark, folder))
    return rows.join(read_table(spark, sf, "embeddings").select("vec_id"), "vec_id", "left_semi")


@query("select distinct vec_id // 64 as picture, 64 as width, 64 as height, true as near, 0::bigint as unreadable from embeddings")
def stills_jpeg(spark, sf):
    # Near: at quality 95 no pixel is off by more than 24 of 255, and the mean square of the errors is below 12 (37 dB).
    folder = new_folder(spark)
    pictures = written_table(_mosaics(spark, sf))
    written_images(pictures, folder, F.lit("jpg"))
    read = media.still_frames(spark, folder).withColumn("picture", key_of()).select("picture", "image", "error")
    both = read.join(pictures, "picture", "left")

    def worst(px, other):
        if px is None:
            return None
        d = px.astype(float) - raster.to_array(other["height"], other["width"], other["channels"], other["data"])
        return float(max(abs(d).max() / 24, (d * d).mean() / 12))

    off = raster.with_image_column(both, "off", "double", worst, "image", ("view_image",))
    return off.groupBy("picture").agg(
        F.max("image.width").alias("width"), F.max("image.height").alias("height"), (F.max("off") < 1).alias("near"), F.count_if(F.col("error").isNotNull()).alias("unreadable")
    )


@query("select picture, round((picture * 37 % 1700) / 10.0::double - 85, 6) as lat, round((picture * 53 % 3500) / 10.0::double - 175, 6) as lon, round(picture % 11 - 5::double, 6) as alt from (select distinct vec_id // 64 as picture from embeddings)")
def placed_images(spark, sf):
    # A third each is written as JPEG, PNG and TIFF, with its place; read back from the files' GPS directories.
    folder, p = new_folder(spark), F.col("picture")
    ext = F.element_at(F.array(*map(F.lit, ("jpg", "png", "tif"))), (p % 3 + 1).cast("int"))
    images = _mosaics(spark, sf).withColumns({"lat": (p * 37 % 1700) / 10.0 - 85, "lon": (p * 53 % 3500) / 10.0 - 175, "alt": (p % 11 - 5).cast("double")})
    written_images(images, folder, ext, more=("lat", "lon", "alt"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", media.STILLS).load(folder)
    return rounded(sinks.read_places(files).select(key_of().alias("picture"), "lat", "lon", "alt"), "lat", "lon", "alt")


@query(f"""with {_PIXELS} select vec_id, string_agg(printf('%02X', m), '' order by y, x) as pixels
from (select vec_id, x // 2 as x, y // 2 as y, round_even(avg(v), 0)::int as m from p group by 1, 2, 3) group by vec_id""")
def thumbnails(spark, sf):
    return raster.with_thumbnail(_pictures(spark, sf), 4).select("vec_id", F.hex("thumbnail.data").alias("pixels"))


# --- raw videos

_CLIPS = f"""{_PIXELS}, h as (select vec_id, string_agg(printf('%02X', v), '' order by i) as pixels from p group by vec_id),
f as (select label::bigint as job_id, row_number() over (partition by label order by vec_id) - 1 as frame_idx, count(*) over (partition by label) as n, pixels from embeddings join h using (vec_id))"""


def _clips(spark, sf) -> str:
    """A folder of raw videos, one for each label, whose frames are its vectors."""
    folder = new_folder(spark)
    names = read_table(spark, sf, "embeddings").select("vec_id", F.col("label").cast("string").alias("name"))
    frames = _pictures(spark, sf).join(names, "vec_id")
    failed = rawvideo.write_videos(frames, folder, 30, order="vec_id").where("error is not null").first()
    if failed:
        raise OSError(f"{failed.path}: {failed.error}")
    return folder


def _clip_rows(frames: DataFrame) -> DataFrame:
    return frames.select(key_of().alias("job_id"), "frame_idx", F.hex("image.data").alias("pixels"))


@query(f"with {_CLIPS} select job_id, frame_idx, pixels from f where frame_idx >= 3")
def raw_video_frames(spark, sf):
    # Pieces of 2 KB, so that a video is read by several tasks; the filter is pushed into the source.
    return _clip_rows(rawvideo.video_frames(spark, _clips(spark, sf), split=2048).where("frame_idx >= 3"))


@query(f"with {_CLIPS} select job_id, frame_idx, pixels from f where frame_idx = case when n > 60 then n // 2 else 0 end")
def raw_video_middle(spark, sf):
    return _clip_rows(rawvideo.video_frames(spark, _clips(spark, sf), only="middle"))


@query(f"with {_CLIPS} select job_id, frame_idx, pixels from f where frame_idx = 0")
def raw_video_first(spark, sf):
    return _clip_rows(fr.first_frame(rawvideo.video_frames(spark, _clips(spark, sf))))


@query(f"with {_CLIPS} select job_id, frame_idx, pixels from f where frame_idx % 15 = 0")
def raw_video_by_keys(spark, sf):
    # Half a second at 30 frames a second; keys are dealt out before frames are decoded.
    keys = rawvideo.frame_keys(media.listed(spark, _clips(spark, sf), media.VIDEOS), interval=(0.5, "seconds"))
    return _clip_rows(rawvideo.decoded(keys.repartition("path", "frame_idx")))


@query("select label::bigint as job_id, 30.0::double as fps, count(*) as frame_count, 8 as width, 8 as height from embeddings group by label")
def raw_video_metadata(spark, sf):
    files = media.listed(spark, _clips(spark, sf), media.VIDEOS)
    return media.media_metadata(files.select("path")).select(key_of().alias("job_id"), "fps", "frame_count", "width", "height")


# --- containers


def write_subtitle_containers(rows: DataFrame, folder: str, fragment: int | None = None) -> DataFrame:
    """(path, samples): a container for each job of rows (job_id, n, text) with one subtitle track, a sample a second.

    Rows are dealt by job and sorted; a task streams texts to a file and holds the sizes alone. With ``fragment`` a file is in fragments of so many samples.
    """
    box = lambda kind, body: struct.pack(">I", 8 + len(body)) + kind + body

    def head(stbl: bytes, more: bytes = b"") -> bytes:
        tkhd = box(b"tkhd", struct.pack(">5I", 0, 0, 0, 1, 0) + bytes(64))
        mdhd = box(b"mdhd", bytes(12) + struct.pack(">II", 1000, 0) + bytes(4))
        stsd = box(b"stsd", bytes(4) + struct.pack(">II", 1, 16) + b"tx3g" + bytes(8))
        return box(b"moov", box(b"trak", tkhd + box(b"mdia", mdhd + box(b"hdlr", bytes(8) + b"sbtl" + bytes(12)) + box(b"minf", box(b"stbl", stsd + stbl)))) + more)

    def moof(sizes: list[int], time: int) -> bytes:
        def made(at: int) -> bytes:
            run = struct.pack(f">IIi{len(sizes)}I", 0x201, len(sizes), at, *sizes)
            return box(b"moof", box(b"mfhd", bytes(8)) + box(b"traf", box(b"tfhd", struct.pack(">II", 0x20000, 1)) + box(b"tfdt", struct.pack(">II", 0, time)) + box(b"trun", run)))

        return made(len(made(0)) + 8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = TaskContext.get().taskAttemptId() if TaskContext.get() else 0
        current, out, sizes, held, start = None, None, [], [], 0

        def part(data: list[bytes], time: int) -> None:
            out.write(moof([len(d) for d in data], time * 1000) + struct.pack(">I4s", 8 + sum(map(len, data)), b"mdat") + b"".join(data))

        def closed() -> pa.RecordBatch:
            if fragment:
                if held:
                    part(held, len(sizes) - len(held))
            else:
                n, body = len(sizes), 16 + sum(sizes)
                stbl = box(b"stsz", struct.pack(f">III{n}I", 0, 0, n, *sizes)) + box(b"stsc", struct.pack(">5I", 0, 1, 1, n, 1)) + box(b"co64", struct.pack(">IIQ", 0, 1, start + 16)) + box(b"stts", struct.pack(">4I", 0, 1, n, 1000))
                out.write(head(stbl))
                out.close()
                with store.open_input_file(name) as f, store.open_output_stream(f"{name}.whole") as whole:  # the size of the samples is known now
                    whole.write(f.read(start) + struct.pack(">I4sQ", 1, b"mdat", body))
                    f.seek(start + 16)
                    while data := f.read(1 << 20):
                        whole.write(data)
                store.delete_file(name)
                store.move(f"{name}.whole", name)
            out.close()
            path = f"{folder}/{current}.mp4"
            store.move(name, located(path)[1])
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(sizes)], pa.int64())], names=["path", "samples"])

        for b in batches:
            for job, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                if job != current:
                    if current is not None:
                        yield closed()
                    current, sizes, held = job, [], []
                    store, name = located(f"{folder}/{job}.mp4.{mark}")
                    store.create_dir(name.rsplit("/", 1)[0], recursive=True)
                    out = store.open_output_stream(name)
                    first = box(b"ftyp", b"isom") + (head(b"", box(b"mvex", box(b"trex", struct.pack(">6I", 0, 1, 1, 1000, 0, 0)))) if fragment else b"")
                    start = len(first)
                    out.write(first + (b"" if fragment else bytes(16)))
                data = text.encode()
                data = struct.pack(">H", len(data)) + data
                sizes.append(len(data))
                if fragment:
                    held.append(data)
                    if len(held) == fragment:
                        part(held, len(sizes) - len(held))
                        held = []
                else:
                    out.write(data)
        if current is not None:
            yield closed()

    return rows.select("job_id", "n", "text").repartition("job_id").sortWithinPartitions("job_id", "n").mapInArrow(run, "path string, samples long")


def _subtitles(spark, sf, fragment=None) -> DataFrame:
    """Samples of containers that hold a job's samples as subtitles."""
    w = _written(spark, sf)
    num = lambda c: F.format_string("%.1f", F.col(c))
    text = F.concat(F.lit("[latitude: "), num("lat"), F.lit("] [longitude: "), num("lon"), F.lit("] [rel_alt: 1.5 abs_alt: "), num("alt"), F.lit("]"))
    folder = new_folder(spark)
    write_subtitle_containers(w.select("job_id", "n", text.alias("text")), folder, fragment).write.format("noop").mode("overwrite").save()
    boxes = containers.container_tracks(media.listed(spark, folder, "*.mp4").select("path"), payloads=True, most=2048)
    samples = tracks.container_samples(boxes.withColumn("job_id", key_of()))
    # Blocks of a part are numbered from 0; every sample has text, so their order is the samples' number.
    seq = F.row_number().over(Window.partitionBy("job_id").orderBy("seq")) - 1
    return rounded(samples.withColumn("seq", seq.cast("long")).select("job_id", "seq", "ts", "lat", "lon", "alt"), "ts", "lat", "lon", "alt")


_SUBTITLES_SQL = f"with {_WRITTEN} select job_id, n as seq, round(n::double, 6) as ts, round(lat, 6) as lat, round(lon, 6) as lon, alt from w"


@query(_SUBTITLES_SQL)
def subtitle_tracks(spark, sf):
    return _subtitles(spark, sf)


@query(_SUBTITLES_SQL)
def fragmented_tracks(spark, sf):
    return _subtitles(spark, sf, 100)


@query(f"with {_WRITTEN} select job_id, 0 as stream_index, 'subtitle' as kind, 'tx3g' as tag, count(*)::double as duration from w group by job_id")
def fragmented_track_list(spark, sf):
    folder = new_folder(spark)
    write_subtitle_containers(_written(spark, sf).select("job_id", "n", F.lit("x").alias("text")), folder, 7).write.format("noop").mode("overwrite").save()
    found = containers.isobmff_tracks(media.listed(spark, folder, "*.mp4").select("path"))
    return found.select(key_of().alias("job_id"), "stream_index", "kind", "tag", "duration")


# --- GPX files


def write_gpx(rows: DataFrame, folder: str) -> DataFrame:
    """(path, points): a file for each job of rows (job_id, n, point), dealt by job and streamed in order of n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = TaskContext.get().taskAttemptId() if TaskContext.get() else 0
        current, out, count, store, name = None, None, 0, None, ""

        def closed() -> pa.RecordBatch:
            out.write(b"</trkseg></trk></gpx>")
            out.close()
            path = f"{folder}/{current}.gpx"
            store.move(name, located(path)[1])
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([count], pa.int64())], names=["path", "points"])

        for b in batches:
            for job, point in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                if job != current:
                    if current is not None:
                        yield closed()
                    current, count = job, 0
                    store, name = located(f"{folder}/{job}.gpx.{mark}")
                    store.create_dir(name.rsplit("/", 1)[0], recursive=True)
                    out = store.open_output_stream(name)
                    out.write(b'<?xml version="1.0"?><gpx xmlns="http://www.topografix.com/GPX/1/1"><trk><trkseg>')
                out.write(point.encode())
                count += 1
        if current is not None:
            yield closed()

    return rows.select("job_id", "n", "point").repartition("job_id").sortWithinPartitions("job_id", "n").mapInArrow(run, "path string, points long")


@query(f"""with {_WRITTEN}, k as (select *, row_number() over (partition by job_id order by n) - 1 as i, min(n) over (partition by job_id) as first from w where n % 5 <> 3)
select job_id, i as seq, round((n - first) * 2.0::double, 6) as ts, round(lat, 6) as lat, round(lon, 6) as lon, case when n % 4 = 1 then 0 else alt end as alt from k""")
def gpx_files(spark, sf):
    # Every fifth point has no time, every fourth no height.
    time = F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("n") * 2), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    time = F.when(F.col("n") % 5 != 3, F.concat(F.lit("<time>"), time, F.lit("</time>"))).otherwise("")
    ele = F.when(F.col("n") % 4 != 1, F.format_string("<ele>%.1f</ele>", "alt")).otherwise("")
    point = F.concat(F.format_string('<trkpt lat="%.1f" lon="%.1f">', "lat", "lon"), ele, time, F.lit("</trkpt>"))
    folder = new_folder(spark)
    write_gpx(_written(spark, sf).select("job_id", "n", point.alias("point")), folder).write.format("noop").mode("overwrite").save()
    g = tracks.read_gpx(spark, folder).withColumn("job_id", key_of())
    return rounded(g.select("job_id", "seq", "ts", "lat", "lon", "alt"), "ts", "lat", "lon", "alt")


# --- masks without detections, and motion


@query("select vec_id, repeat('FF', 30) as mask from embeddings")
def empty_masks(spark, sf):
    rows = read_table(spark, sf, "embeddings").select("vec_id", F.lit(5).alias("height"), F.lit(6).alias("width"), F.lit(None).cast("array<struct<height:int,width:int,prob:array<double>>>").alias("found"))
    return det.with_sized_masks(rows).select("vec_id", F.hex("mask.data").alias("mask"))


@query("select label::bigint as job_id, count(*) as still, 1::bigint as kept from embeddings group by label")
def motion_of_still_scenes(spark, sf):
    # A label's frames are all its first picture, so nothing moves, and the first one alone is kept.
    first = read_table(spark, sf, "embeddings").groupBy(F.col("label").cast("long").alias("job_id")).agg(F.min("vec_id").alias("vec_id"))
    scenes = read_table(spark, sf, "embeddings").select(F.col("label").cast("long").alias("job_id"), F.col("vec_id").alias("frame_idx"))
    frames = scenes.join(_pictures(spark, sf).join(first, "vec_id").select("job_id", "image"), "job_id")
    kept = fr.motion_keys(frames, 0.0001, job="job_id").groupBy("job_id").agg(F.count("*").alias("kept"))
    return scenes.groupBy("job_id").agg(F.count("*").alias("still")).join(kept, "job_id").select("job_id", "still", "kept")


@query(f"with {_PIXELS} select distinct vec_id // 64 as picture, 20 as small, 95 as large, true as smaller from p")
def jpeg_quality(spark, sf):
    def less(px):
        return 1.0 if px is not None and len(jpeg.encode_jpeg(px, 20)) < len(jpeg.encode_jpeg(px, 95)) else 0.0

    out = raster.with_image_column(_mosaics(spark, sf), "less", "double", less, "view_image")
    return out.select("picture", F.lit(20).alias("small"), F.lit(95).alias("large"), (F.col("less") == 1).alias("smaller"))


# --- settings of rows

_RULES = """r as (select o_orderkey as job_id, case when o_orderkey % 4 = 0 then (o_custkey % 9) / 2.0::double end as cli_interval, case when o_orderkey % 3 = 0 then (o_custkey % 7)::double end as cfg_value,
  case when o_orderkey % 5 = 0 then (o_custkey % 5)::double end as cfg_alias, case when o_orderkey % 2 = 0 then 'Frames' end as cfg_unit,
  case o_orderkey % 3 when 0 then 'Vehicles, plants' when 1 then '' end as targets, case when o_custkey % 2 = 0 then o_custkey % 4 = 0 end as cfg_flag,
  case when o_orderkey % 7 = 0 then 'simple' end as cli_mode, case when o_orderkey % 5 = 1 then '{frame}' end as cli_image, case when o_orderkey % 5 = 2 then '{camera}' end as cli_mask,
  case when o_custkey % 3 = 0 then 'simple' end as cfg_mode, o_custkey % 6 = 0 as on_flag from orders)"""


@query(f"""with {_RULES} select job_id, coalesce(cli_interval, cfg_value, cfg_alias, 1.0::double) as interval_value, case when cli_interval is not null then 'Seconds' else coalesce(cfg_unit, 'Seconds') end as interval_unit,
  case when targets is not null then false else coalesce(cfg_flag, true) end as ai_detect_humans,
  case when targets is not null then targets like '%Vehicles%' else coalesce(cfg_flag, false) end as ai_detect_vehicles, case when targets is not null then targets like '%plants%' else coalesce(cfg_flag, false) end as ai_detect_plants,
  coalesce(cli_mode, case when cli_image is not null or cli_mask is not null then 'custom' end, cfg_mode, 'realityscan') as naming_mode,
  case when on_flag then true else coalesce(cfg_flag, false) end as adaptive_mode, case when on_flag then true else coalesce(cfg_flag, false) end as export_telemetry, case when on_flag then false else coalesce(cfg_flag, true) end as is_360 from r""")
def settings_rules(spark, sf):
    return settings_rows(read_table(spark, sf, "orders"))


def settings_rows(orders: DataFrame) -> DataFrame:
    """Settings of runs that each order stands for, by the rules of layers."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    value, unit = settings.interval_columns(F.when(k % 4 == 0, (c % 9) / 2.0), F.when(k % 3 == 0, c % 7), F.when(k % 5 == 0, c % 5), F.when(k % 2 == 0, "Frames"))
    flag, on = F.when(c % 2 == 0, c % 4 == 0), c % 6 == 0
    targets = settings.target_columns(F.when(k % 3 == 0, "Vehicles, plants").when(k % 3 == 1, ""), dict.fromkeys(settings.TARGETS, flag))
    mode = settings.naming_column(F.when(k % 7 == 0, "simple"), F.when(k % 5 == 1, "{frame}"), F.when(k % 5 == 2, "{camera}"), F.when(c % 3 == 0, "simple"))
    switched = {key: settings.switched_column(key, on, flag) for key in ("adaptive_mode", "export_telemetry", "is_360")}
    return orders.select(k.alias("job_id"), value.alias("interval_value"), unit.alias("interval_unit"), *(x.alias(n) for n, x in (targets | {"naming_mode": mode} | switched).items()))


@query("select vec_id, 'pass' as ai_action, false as masked from embeddings")
def detector_missing(spark, sf):
    def broken():
        raise OSError("no weights")

    seen = det.with_detector(_pictures(spark, sf), broken, "generate_mask", 0.5, [0], image="image")
    return seen.select("vec_id", "ai_action", F.col("mask").isNotNull().alias("masked"))


# --- kernels on pixels

@query("select vec_id, 21::bigint as pixels, 21::bigint as nearest from embeddings")
def gray_pixels(spark, sf):
    # Every gray value is the nearest one to the weighted sum, to whichever side halves go: checked in whole numbers, a thousandth each.
    v = F.transform(F.slice("embedding", 1, 63), lambda e: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(e.cast("double") * 256 + 128))))
    colored = read_table(spark, sf, "embeddings").select("vec_id", v.alias("v"), _image(v, 21, 1, 3).alias("image"))
    out = raster.with_image_column(colored, "gray", raster.IMAGE, lambda px: None if px is None else raster.gray(px))
    digits = F.hex("gray.data")
    value = lambda i: F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("long")
    channel = lambda i, k: F.get("v", (i * 3 + k).cast("int"))
    off = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.abs(value(i) * 1000 - channel(i, 0) * 114 - channel(i, 1) * 587 - channel(i, 2) * 299))
    return out.select("vec_id", (F.length(digits) / 2).cast("long").alias("pixels"), F.size(F.filter(off, lambda x: x <= 500)).cast("long").alias("nearest"))


@query(f"""with {_PIXELS}, l as (select a.vec_id, a.i, sum(b.v) - 4 * max(a.v) as lap from p a join (values (0, -1), (0, 1), (-1, 0), (1, 0)) d(dx, dy) on true
  join p b on b.vec_id = a.vec_id and b.x = (case when a.x + dx < 0 then 1 when a.x + dx > 7 then 6 else a.x + dx end) and b.y = (case when a.y + dy < 0 then 1 when a.y + dy > 7 then 6 else a.y + dy end) group by 1, 2)
select vec_id, round(var_pop(lap), 6) as score from l group by vec_id""")
def blur_score_of_images(spark, sf):
    return rounded(raster.with_image_column(_pictures(spark, sf), "score", "double", raster.blur_score).select("vec_id", "score"), "score")


@query("""select o_orderkey as job_id, o_orderkey % 5 < 4 as is_media, o_orderkey % 5 in (1, 3) as is_image from orders""")
def media_kinds(spark, sf):
    k = F.col("o_orderkey")
    end = F.element_at(F.array(*map(F.lit, (".MP4", ".jpg", ".x.mkv", ".TIFF", ".txt"))), (k % 5 + 1).cast("int"))
    o = read_table(spark, sf, "orders").select(k.alias("job_id"), F.concat(F.lit("/in/a.b/"), k.cast("string"), end).alias("path"))
    return o.select("job_id", naming.is_media(F.col("path")).alias("is_media"), naming.is_image(F.col("path")).alias("is_image"))


# --- the whole extraction, from files to files


def _extracted(spark, sf, **more) -> DataFrame:
    """The manifest of an extraction of the tables' pictures, written as PNGs, with two views of each."""
    from orbitframe import cli

    folder = new_folder(spark)
    written_images(_mosaics(spark, sf), folder, F.lit("png"))
    s = settings.DEFAULTS | {"resolution": 8, "camera_count": 2, "naming_mode": "simple", "detector": None, "detections": None} | more
    done = cli.extract(spark, folder, s)
    name = F.element_at(F.split("path", "/"), -1)
    return done.select(F.element_at(F.split("path", "/"), -2).alias("folder"), name.alias("name"), "ok", (F.col("length") > 0).alias("written"))


_VIEWS_SQL = "v as (select p.picture, i from (select distinct vec_id // 64 as picture from embeddings) p, range(2) r(i))"


@query(f"with {_VIEWS_SQL} select picture || '_processed' as folder, picture || '_frame000000_View_' || i || '.jpg' as name, true as ok, true as written from v")
def extracted_files(spark, sf):
    return _extracted(spark, sf)


@query(f"""with {_VIEWS_SQL} select picture || '_processed' as folder, picture || '_frame000000_View_' || i || x as name, true as ok, true as written from v, (values ('.tif'), ('_mask.png')) e(x) where (picture + i) % 3 > 0 or x = '.tif'
union all select picture || '_processed', picture || '_frame000000_View_' || i || '_mask.png', true, true from v where (picture + i) % 3 = 0""")
def extracted_masks(spark, sf):
    # A third of the views have a detection; every view gets a mask, the others an empty one.
    views = _mosaics(spark, sf).select("picture", F.explode(F.array(F.lit(0), F.lit(1))).alias("i")).where((F.col("picture") + F.col("i")) % 3 == 0)
    table = new_folder(spark)
    found = views.select(
        F.lit(None).cast("string").alias("path"), "picture", F.lit(0).cast("long").alias("frame_idx"), F.concat(F.lit("View_"), F.col("i").cast("string")).alias("name"), F.lit(0).alias("class_id"), F.lit(0.9).alias("conf"),
        F.lit(8).alias("height"), F.lit(8).alias("width"), F.array_repeat(F.lit(0.8), 64).alias("prob"),
    )
    folder = new_folder(spark)
    written_images(_mosaics(spark, sf), folder, F.lit("png"))
    places = media.listed(spark, folder, media.STILLS).select(F.col("path").alias("at"), key_of().alias("picture"))
    found.join(places, "picture").withColumn("path", F.col("at")).drop("at", "picture").write.parquet(table)
    from orbitframe import cli

    s = settings.DEFAULTS | {"resolution": 8, "camera_count": 2, "naming_mode": "simple", "output_format": "tiff", "ai_mode": settings.AI_MASK, "detections": table, "detector": None}
    done = cli.extract(spark, folder, s)
    return done.select(F.element_at(F.split("path", "/"), -2).alias("folder"), F.element_at(F.split("path", "/"), -1).alias("name"), "ok", (F.col("length") > 0).alias("written"))
