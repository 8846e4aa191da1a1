"""Extraction as one plan: sample, filter, look through views, locate, name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from orbitframe.functions import geometry, naming
from orbitframe.operators import frames as fr, telemetry


def event_frames(events: DataFrame) -> DataFrame:
    """Frames from the events table: users are jobs, rows in time order frames, values scores."""
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - 1_704_067_200
    return events.select(F.col("user_id").alias("job_id"), (F.row_number().over(by) - 1).cast("int").alias("frame_idx"), t.alias("t"), F.col("event_type").alias("face"), F.col("value").alias("score"), "event_id")


def event_samples(events: DataFrame) -> DataFrame:
    """Telemetry from the events table; positions come from event_id and are partly out of range."""
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - 1_704_067_200
    lat, lon = (F.col("event_id") * 37 % 2000) / 10.0 - 100, (F.col("event_id") * 53 % 4000) / 10.0 - 200
    return events.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), t.alias("ts"), lat.alias("lat"), lon.alias("lon"), F.col("value").alias("alt"))


def extraction(frames: DataFrame, samples: DataFrame, views: DataFrame, step: int, floor: float, ext: str = "jpg") -> DataFrame:
    """Named, located views of the sampled frames whose score reaches the floor.

    Cheap filters come first, positions are looked up once a frame, and views multiply rows last.
    """
    kept = fr.blur_floor(fr.sampled(frames, step), floor)
    placed = telemetry.interpolated(kept, telemetry.sanitized(samples))
    looks = placed.crossJoin(F.broadcast(views.select("view_idx", "name", "yaw", "pitch")))
    image, mask = naming.output_names("realityscan", F.concat(F.lit("job"), F.col("job_id")), F.col("frame_idx"), F.col("name"), ext)
    return looks.select("job_id", "frame_idx", "view_idx", "yaw", "pitch", *(decimals(F.col(c), 6).alias(c) for c in ("t", "score", "lat", "lon", "alt")), image.alias("image_name"), mask.alias("mask_name"))


def decimals(c: Column, digits: int) -> Column:
    """A double as DuckDB rounds it: the whole number next to its multiple, halves away from zero. Spark's own round goes by the shortest decimal
    that reads as the double, so what lies just below a half (8.1375, that is 8137.499999999999 thousandths) would go up."""
    return F.round(c * 10.0**digits) / 10.0**digits


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    samples = event_samples(events).where("seq % 3 = 0")
    return extraction(event_frames(events), samples, geometry.generate_views(spark, 6, -20.0), 2, 50.0)
