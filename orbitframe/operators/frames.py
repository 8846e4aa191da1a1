"""Frame streams: sampling, times, and the two order-dependent filters."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from orbitframe.functions import raster


def interval_step(value: Column, unit: Column, fps: Column) -> Column:
    """Frames from one sample to the next, at least 1; seconds count fps frames, cut towards zero."""
    frames = F.when(F.lower(unit) == "frames", value).otherwise(fps * value)
    return F.greatest(F.lit(1.0), frames.cast("double")).cast("int")


def sampled(frames: DataFrame, step) -> DataFrame:
    """Every ``step``-th frame of each job, by frame_idx."""
    step = step if isinstance(step, Column) else F.lit(step)
    return frames.where(F.col("frame_idx") % step == 0)


def frame_time(idx: Column, fps: Column) -> Column:
    return F.when(fps > 0, idx / fps).otherwise(F.lit(0.0))


def ordered_scan(df: DataFrame, job: str, order: list[str], value: str, flag: str, start: Callable[[], Callable]) -> DataFrame:
    """df with a boolean column that a state machine gives row by row in each job's order.

    ``start()`` makes a fresh machine for a job: a function of the value to the flag. Jobs are dealt to
    partitions, sorted there, and stepped through batch by batch; what a task holds is one batch and one
    job's state, however long the job. Rows of one job are inherently sequential.
    """
    schema = StructType([*df.schema.fields, StructField(flag, BooleanType())])
    at, by = df.columns.index(value), df.columns.index(job)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, machine = object(), None
        for b in batches:
            flags = np.empty(b.num_rows, bool)
            for i, (j, x) in enumerate(zip(b.column(by).to_pylist(), b.column(at).to_pylist())):
                if machine is None or j != current:
                    current, machine = j, start()
                flags[i] = machine(x)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(flags)], names=[*b.schema.names, flag])

    dealt = df.repartition(F.col(job)).sortWithinPartitions(job, *order)
    return dealt.mapInArrow(run, schema)


def keyframe_machine(threshold: float, motion: Callable[[object, object], float]) -> Callable[[], Callable]:
    """Keeps a job's first row, then each whose motion from the last kept one exceeds the threshold."""

    def start():
        last: list = []

        def step(x) -> bool:
            if not last or motion(last[0], x) > threshold:
                last[:] = [x]
                return True
            return False

        return step

    return start


def plain_mean(values: Iterable[float]) -> float:
    """The mean by a plain sum from the left, as SQL has it; Python's sum corrects what each step rounds, which decides scores on the limit otherwise."""
    total = n = 0
    for v in values:
        total, n = total + v, n + 1
    return total / n


def smart_blur_machine(floor: float, factor: float = 0.6, history: int = 10, patience: int = 5) -> Callable[[], Callable]:
    """Drops blurry rows: below the floor, or below ``factor`` times the mean of the last accepted scores.

    After ``patience`` dropped in a row the next blurry one is accepted. Null scores count as 0.
    """

    def start():
        recent: deque = deque(maxlen=history)
        skips = 0

        def step(score) -> bool:
            nonlocal skips
            score = 0.0 if score is None else score
            if score < floor or (recent and score < factor * plain_mean(recent)):
                skips += 1
                if skips <= patience:
                    return False
            skips = 0
            recent.append(score)
            return True

        return step

    return start


def kept_rows(df: DataFrame, job: str, order: tuple[str, ...], value: Column, start: Callable[[], Callable]) -> DataFrame:
    """df's rows that the machine keeps. Wide rows (images) stay where they are: only keys and values are scanned, and flags joined."""
    wide = [f.name for f in df.schema if f.dataType.typeName() in ("struct", "binary")]
    if not wide:
        return ordered_scan(df.withColumn("_value", value), job, list(order), "_value", "_keep", start).where("_keep").drop("_keep", "_value")
    narrow = df.select(job, *order, value.alias("_value"))
    kept = ordered_scan(narrow, job, list(order), "_value", "_keep", start).where("_keep").select(job, *order)
    return df.join(kept, [job, *order], "left_semi")


def adaptive_keyframes(frames: DataFrame, threshold: float, value: str = "value", job: str = "job_id", order: tuple[str, ...] = ("frame_idx",)) -> DataFrame:
    """Rows that move more than ``threshold`` from the last kept row of their job; numbers or arrays."""

    def motion(a, b) -> float:
        if a is None or b is None:
            return 0.0
        return float(np.mean(np.abs(np.asarray(b, float) - np.asarray(a, float))))

    return kept_rows(frames, job, order, F.col(value), keyframe_machine(threshold, motion))


def picture_motion(a: dict | None, b: dict | None) -> float:
    """Mean flow between two image structs, as small gray images; equal ones don't move, without the flow being worked out."""
    if a is None or b is None or a == b:
        return 0.0
    return raster.motion_score(*(raster.motion_input(raster.to_array(x["height"], x["width"], x["channels"], x["data"])) for x in (a, b)))


def motion_keys(frames: DataFrame, threshold: float, image: str = "image", job: str = "path", order: tuple[str, ...] = ("frame_idx",)) -> DataFrame:
    """(job, order) of the frames whose mean flow from the last kept frame of their job exceeds ``threshold``; unreadable frames don't move.

    What is dealt out and sorted are the small gray images that the flow is taken of, or the frames themselves where these are smaller still.
    """

    held = [None, None, 0.0]

    def motion(a, b) -> float:  # a scene that rests after it moved is compared with the kept frame once
        if held[0] is not a or held[1] != b:
            held[:] = a, b, picture_motion(a, b)
        return held[2]

    def small(img):
        return img if img is None or img.size <= 256 * 144 else raster.motion_input(img)

    dealt = raster.with_image_column(frames.select(job, *order, image), "_small", raster.IMAGE, small, image).drop(image)
    return ordered_scan(dealt, job, list(order), "_small", "_keep", keyframe_machine(threshold, motion)).where("_keep").select(job, *order)


def motion_keyframes(frames: DataFrame, threshold: float, image: str = "image", job: str = "path", order: tuple[str, ...] = ("frame_idx",)) -> DataFrame:
    """The frames of motion_keys. The frames are worked out twice; where that is dear, filter keys by motion_keys and decode what is left."""
    return frames.join(motion_keys(frames, threshold, image, job, order), [job, *order], "left_semi")


def blur_floor(frames: DataFrame, floor: float, score: str = "score") -> DataFrame:
    """Rows whose score reaches the floor; equality is kept."""
    return frames.where(F.col(score) >= floor)


def smart_blur(frames: DataFrame, floor: float, score: str = "score", job: str = "job_id", order: tuple[str, ...] = ("frame_idx", "view_idx")) -> DataFrame:
    """Accepted rows of the smart blur filter; one state per job across views in (frame, view) order."""
    return kept_rows(frames, job, order, F.col(score), smart_blur_machine(floor))


def middle_frame(frames: DataFrame, job: str = "job_id", idx: str = "frame_idx") -> DataFrame:
    """The frame that stands for each job: number count // 2 where there are more than 60, else the first.

    Counts meet the frames in a join on the job; no job passes through a window.
    """
    n = frames.groupBy(F.col(job).alias("_job")).agg(F.count("*").alias("_n"))
    at = F.when(F.col("_n") > 60, F.floor(F.col("_n") / 2)).otherwise(F.lit(0))
    return frames.join(n, F.col(job).eqNullSafe(F.col("_job"))).where(F.col(idx) == at).drop("_job", "_n")


def first_frame(frames: DataFrame, idx: str = "frame_idx") -> DataFrame:
    """The first frame of each job; with a source that takes a step, it reads nothing else."""
    return frames.where(F.col(idx) == 0)


def blur_summary(scores: DataFrame, *by: str) -> DataFrame:
    """Average, min and max score, the details in view order, and 0.8 of the average as threshold: a row for each of ``by``.

    Without ``by`` there is one row, of zeros and no details where there are no scores.
    """
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return scores.groupBy(*by).agg(
        zero(F.avg("score")).alias("average"), zero(F.min("score")).alias("min"), zero(F.max("score")).alias("max"),
        F.transform(F.array_sort(F.collect_list(F.struct("view_idx", "name", "score"))), lambda x: F.struct(x["name"].alias("view"), x["score"].alias("score"))).alias("details"),
    ).withColumn("recommended", F.col("average") * 0.8)
