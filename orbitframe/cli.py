"""The command line: list media, extract views of still images and raw videos, write them with a manifest."""

from __future__ import annotations

import os
import sys
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from orbitframe.functions import geometry, naming, raster
from orbitframe.operators import detections as det, frames as fr, telemetry
from orbitframe.plans import settings
from orbitframe.session import written_table
from orbitframe.sources import containers, media, rawvideo, sinks, tracks

#: Files that places come from, and the formats that are written, with their suffixes.
TEXTS, CONTAINERS = "*.[sS][rR][tT]", "*.{[mM][pP]4,[mM][oO][vV]}"
FORMATS = {"jpg": "jpg", "jpeg": "jpg", "png": "png", "tiff": "tif", "tif": "tif"}
#: Tasks that raw frames are dealt to, for each core.
SPREAD = 4


def stem_key(path: str = "path"):
    """What files of one folder and name share, whatever their suffix."""
    return F.xxhash64(F.lower(F.regexp_replace(media.same_path(F.col(path)), r"\.[^./]*$", "")))


def samples_of(spark: SparkSession, folder: str, altitude_mode: str) -> DataFrame:
    """Samples of each stem from its .gpx file, else its .srt file, else the first telemetry track of its container.

    Of containers only headers and the tracks' samples are read.
    """
    key = stem_key().alias("job_id")
    texts = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", TEXTS).load(folder)
    of = lambda suffix: texts.where(naming.suffix(F.col("path")) == suffix).select(key, "content")
    boxes = containers.container_tracks(media.listed(spark, folder, CONTAINERS).select("path"), payloads=True)
    streams = boxes.select(key, F.col("path").alias("media_id"), "kind", "tag", "stream_index", F.lit(0).alias("samples"), "duration", "part", "payload")
    chosen = tracks.container_samples(telemetry.chosen_tracks(streams), altitude_mode=altitude_mode)
    gpx = tracks.read_gpx(spark, folder).withColumn("job_id", key).drop("path")
    parsed = [gpx, tracks.parse_srt(of("srt"), altitude_mode), chosen]
    every = None
    for rank, part in enumerate(parsed):
        part = telemetry.sanitized(part).withColumn("rank", F.lit(rank))
        every = part if every is None else every.unionByName(part)
    best = every.groupBy(F.col("job_id").alias("best_job")).agg(F.min("rank").alias("best"))
    return every.join(best, (F.col("job_id") == F.col("best_job")) & (F.col("rank") == F.col("best"))).drop("rank", "best", "best_job")


def located(rows: DataFrame, samples: DataFrame) -> DataFrame:
    """rows (path, frame_idx, fps, ...) with lat, lon and alt from samples of the same folder and stem; null without any."""
    times = rows.select(stem_key().alias("job_id"), "path", "frame_idx", fr.frame_time(F.col("frame_idx"), F.col("fps")).alias("t")).distinct()
    places = telemetry.interpolated(times, samples)
    return rows.join(places.select("path", "frame_idx", "lat", "lon", "alt"), ["path", "frame_idx"], "left")


def video_keys(spark: SparkSession, folder: str, s: dict) -> DataFrame:
    """The frames to take of the raw videos, by place; with adaptive keyframes those that move, for which small images are taken of all."""
    keys = rawvideo.frame_keys(media.listed(spark, folder, media.VIDEOS), interval=(float(s["interval_value"]), s["interval_unit"]))
    # Runs of neighbouring frames, so that a long file is many tasks and a task opens few files.
    keys = written_table(keys)
    deal = lambda k: k.repartitionByRange(SPREAD * spark.sparkContext.defaultParallelism, "path", "frame_idx")
    if s["adaptive_mode"]:
        moving = fr.motion_keys(rawvideo.decoded(deal(keys.where("error is null"))), float(s["adaptive_threshold"]))
        keys = written_table(keys.join(moving, ["path", "frame_idx"], "left_semi").unionByName(keys.where("error is not null")))
    return deal(keys)


def looks_of(frames: DataFrame, s: dict) -> DataFrame:
    """frames as views with view_image, score, ai_action and mask, a row for each view; a frame with an error is one row."""
    spark = frames.sparkSession
    if s["is_360"]:
        views = geometry.generate_views(spark, int(s["camera_count"]), float(s["pitch_offset"]), s["layout_mode"])
        views = geometry.active_views(views, s.get("active_cameras"))
        first = views.agg(F.min("view_idx")).first()[0]
        looks = raster.reproject(frames, views, int(s["resolution"]), float(s["fov"]), s["interpolation_mode"] == "lanczos")
        looks = looks.where(F.col("error").isNull() | (F.col("view_idx") == F.lit(first)))
    else:
        looks = frames.withColumns({"name": F.lit("flat"), "view_idx": F.lit(0), "view_image": F.col("image")})
    looks = looks.drop("image")
    looks = raster.with_image_column(looks, "score", "double", raster.blur_score, "view_image") if s["blur_filter_enabled"] else looks.withColumn("score", F.lit(None).cast("double"))
    if s["blur_filter_enabled"] and not s["smart_blur_enabled"]:
        looks = looks.where((F.col("score") >= float(s["blur_threshold"])) | F.col("error").isNotNull())
    if s["sharpening_enabled"]:
        looks = raster.with_image_column(looks.withColumnRenamed("view_image", "_plain"), "view_image", raster.IMAGE, lambda px: None if px is None else raster.sharpen(px, float(s["sharpening_strength"])), "_plain").drop("_plain")
    mode, scope = ai_mode(s), face_scope(s)
    if mode is None or not s.get("detector"):
        return looks.withColumns({"ai_action": F.lit("pass"), "mask": F.lit(None).cast(raster.IMAGE)})
    looks = looks.withColumn("_inside", F.lit(True) if scope is None else det.in_scope(F.col("name"), scope))
    make = det.maker(s["detector"])
    return det.with_detector(looks, make, mode, float(s["ai_confidence"]), wanted_classes(s), bool(s["ai_invert_mask"]), bool(s["feather_mask"]), scope="_inside").drop("_inside")


def ai_mode(s: dict) -> str | None:
    return {settings.AI_SKIP: "skip_frame", settings.AI_MASK: "generate_mask"}.get(s["ai_mode"])


def face_scope(s: dict):
    return det.face_scope(F.lit(",".join(s["ai_mask_cameras"]))) if s["ai_mask_cameras"] else None


def wanted_classes(s: dict) -> list[int]:
    custom = [k for k, name in enumerate(det.COCO) if name in {x.strip().lower() for x in s["ai_custom_classes"].split(",")}]
    return sorted({k for c in det.PRESETS if s[f"ai_detect_{c}"] for k in det.PRESETS[c]} | set(custom)) or [0]


def with_table_outcomes(rows: DataFrame, s: dict) -> tuple[DataFrame, DataFrame | None]:
    """rows with the ai_action that the table of detections in the settings gives them, and the detections, if there are."""
    mode = ai_mode(s)
    if mode is None or not s.get("detections"):
        return rows, None
    on, scope = ["path", "frame_idx", "name"], face_scope(s)
    found = det.confident(rows.sparkSession.read.parquet(s["detections"]), wanted_classes(s), float(s["ai_confidence"]))
    found = found.withColumn("path", media.same_path(F.regexp_replace("path", "^/", "file:/")))
    return det.outcomes(rows.drop("ai_action"), found.withColumn("has_mask", F.col("prob").isNotNull()), on, mode, None if scope is None else det.in_scope(F.col("name"), scope)), found


def table_masks(kept: DataFrame, found: DataFrame, s: dict) -> DataFrame:
    """(output_dir, image_name, view_image): the masks of kept views from a table of detections; the views' sizes are known, so no image is read again."""
    on = ["path", "frame_idx", "name"]
    rows = kept.where(F.col("ai_action").isin("mask", "empty_mask")).select(*on, "output_dir", F.col("mask_name").alias("image_name"), "ai_action", "height", "width")
    found = found.where("prob is not null").groupBy(*on).agg(F.collect_list(F.struct("height", "width", "prob")).alias("found"))
    return det.with_sized_masks(rows.join(found, on, "left"), bool(s["ai_invert_mask"]), bool(s["feather_mask"]), "view_image").select("output_dir", "image_name", "view_image")


def staged_views(spark: SparkSession, folder: str, s: dict, run_id: str) -> DataFrame:
    """The rows of sinks.staged for every view, and mask of a detector: one pass from the files that are read to those of the attempt."""
    frames = media.still_frames(spark, folder).withColumn("place", F.lit(None).cast("long"))
    frames = frames.unionByName(rawvideo.decoded(video_keys(spark, folder, s)))
    looks = looks_of(frames, s)
    ext = FORMATS[s["output_format"].lower()]
    image, mask = naming.output_names(s["naming_mode"], naming.stem(F.col("path")), F.col("frame_idx"), F.col("name"), ext, s["image_pattern"], s["mask_pattern"])
    folder_of = naming.output_dir(F.regexp_replace("path", "^file:/+", "/"), F.lit(s["custom_output_dir"] if os.path.isdir(s["custom_output_dir"] or "") else ""))
    row = ("path", "frame_idx", "fps", "name", "view_idx", "score", "ai_action", "error")
    size = (F.col("view_image.height").alias("height"), F.col("view_image.width").alias("width"))
    looks = looks.select(*row, *size, folder_of.alias("output_dir"), image.alias("image_name"), mask.alias("mask_name"), "view_image", "mask")
    if s.get("detector"):
        file = lambda name, px, kind, is_mask: F.struct(F.col(name).alias("file_name"), F.col(px).alias("px"), F.lit(kind).alias("ext"), F.lit(is_mask).alias("is_mask"))
        files = F.filter(F.array(file("image_name", "view_image", ext, False), file("mask_name", "mask", "png", True)), lambda f: ~f.is_mask | f.px.isNotNull())
        looks = looks.select(*row, "height", "width", "output_dir", "mask_name", F.inline(files))
    else:
        looks = looks.select(*row, "height", "width", "output_dir", "mask_name", F.col("image_name").alias("file_name"), F.col("view_image").alias("px"), F.lit(ext).alias("ext"), F.lit(False).alias("is_mask"))
    files = sinks.encoded(looks, "px", quality=int(s["quality"]), ext_col="ext").drop("px")
    return sinks.staged(files, run_id, name="file_name")


def extract(spark: SparkSession, folder: str, s: dict) -> DataFrame:
    """The manifest (path, length, ok, error) of views and masks written for the images and raw videos under a folder.

    Each image is decoded once, whatever the settings, in one stage that ends in files of the attempt; raw frames are read twice for adaptive
    keyframes, the second time only those kept. Images don't pass through joins or exchanges: smart blur, places and outcomes of a table are decided on
    the rows of what was staged, and then files are published or dropped. A file that can't be read is a row with the error and ends nothing else.
    """
    run_id = uuid.uuid4().hex
    manifest = written_table(staged_views(spark, folder, s, run_id))
    rows, found = with_table_outcomes(manifest, s)
    keep = F.col("ai_action") != "drop"
    if s["blur_filter_enabled"] and s["smart_blur_enabled"]:
        on = ["path", "frame_idx", "view_idx"]
        sharp = fr.smart_blur(manifest.where("not is_mask and error is null").select(*on, "score"), float(s["blur_threshold"]), job="path").select(*on, F.lit(True).alias("sharp"))
        rows = rows.join(sharp, on, "left")
        keep = keep & (F.col("sharp").isNotNull() | F.col("error").isNotNull())
    if s["export_telemetry"]:
        places = samples_of(spark, folder, s["altitude_mode"])
        rows = located(rows, places).withColumns({c: F.when(~F.col("is_mask"), F.col(c)) for c in ("lat", "lon", "alt")})
    rows = written_table(rows.withColumn("keep", keep))
    done = written_table(sinks.published(rows, name="file_name"))
    if found is not None and ai_mode(s) == "generate_mask":
        masks = sinks.encoded(table_masks(rows.where("keep and part is not null"), found, s))
        masks = written_table(sinks.staged(masks.drop("view_image"), run_id)).withColumn("keep", F.lit(True))
        done = written_table(done.unionByName(sinks.published(masks)))
    sinks.cleared(rows, run_id).write.format("noop").mode("overwrite").save()
    return done


def refused(s: dict) -> str | None:
    """Why settings, of the command line or a config, can't be carried out, or None. Nothing that is asked for is left out silently."""
    if s["output_format"].lower() not in FORMATS:
        return f"format {s['output_format']}: jpg, png and tiff are written"
    if not str(s["quality"]).isdigit() or not 1 <= int(s["quality"]) <= 100:
        return f"quality {s['quality']}: 1 to 100"
    if s["altitude_mode"] not in ("absolute", "relative"):
        return f"altitude mode {s['altitude_mode']}: absolute or relative"
    if s.get("detector"):
        try:
            det.maker(s["detector"])
        except LookupError as e:
            return str(e)
    return None


def main(argv: list[str] | None = None) -> int:
    args = vars(settings.arguments().parse_args(argv))
    try:
        config = settings.load_config(args.pop("config"))
    except (OSError, ValueError) as e:
        print(f"config: {e}", file=sys.stderr)
        return 1
    folder = args.pop("input") or config.get("input")
    if not folder:
        print("no input given", file=sys.stderr)
        return 1
    args["active_cameras"] = geometry.parse_active(args["active_cameras"])
    args["custom_output_dir"] = args.pop("output")
    s = settings.resolved(config, args) | {k: args[k] or config.get(k) for k in ("detections", "detector")}
    if why := refused(s):
        print(why, file=sys.stderr)
        return 1
    if s["ai_mode"] != settings.AI_NONE and not (s["detections"] or s["detector"]):
        print("no --detector and no --detections table: views pass as without a detector", file=sys.stderr)
    try:
        done = extract(SparkSession.builder.getOrCreate(), folder, s)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        print(f"input not found: {folder}", file=sys.stderr)
        return 1
    counts = done.agg(F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("failed")).first()
    print(f"{counts.ok} written, {counts.failed} failed")
    return 0 if not counts.failed else 2


if __name__ == "__main__":
    sys.exit(main())
