"""Jobs: progress, outcomes, output folders and summaries."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Names of jobs to stop by the tag of their batch; ALL stands for every one.
_STOPPED: dict[str, set[str]] = {}
ALL = "\0all"


def progress(idx: Column, total: Column, elapsed: Column) -> tuple[Column, Column]:
    """(percent, time left as 'Xm Ys'); '--m --s' before the first frame."""
    left = F.floor((total - idx) / (idx / elapsed)).cast("long")
    text = F.format_string("%dm %ds", F.floor(left / 60).cast("long"), left % 60)
    return F.floor(idx * 100 / total).cast("int"), F.when((idx > 0) & (elapsed > 0), text).otherwise("--m --s")


def batch_progress(jobs: DataFrame, idx: str, percent: str) -> DataFrame:
    """jobs with batch_percent: finished jobs and the share of the running one, of all."""
    n = jobs.agg(F.count("*").alias("_n"))  # one row
    share = F.floor((F.col(idx) * 100 + F.col(percent)) / F.col("_n")).cast("int")
    return jobs.crossJoin(F.broadcast(n)).withColumn("batch_percent", share).drop("_n")


def outcome(jobs: DataFrame, status: str = "status") -> DataFrame:
    """One row: counts by state and the batch's outcome; cancelled before errors before success."""
    s = F.col(status)
    counts = jobs.agg(F.count("*").alias("n_jobs"), F.count_if(s == "Error").alias("n_errors"), F.count_if(s == "Pending").alias("n_pending"))
    return counts.withColumn("outcome", F.when(F.col("n_pending") > 0, "cancelled").when(F.col("n_errors") > 0, "errors").otherwise("success"))


def run_batch(spark: SparkSession, work: dict[str, Callable[[], object]], tag: str | None = None) -> DataFrame:
    """(job, status, error) of a batch, for ``outcome``: its jobs run one after another under Spark job tags, so that others can stop them.

    stop_batch(spark, tag) ends the running job (Cancelled) and leaves the rest Pending; stop_job(spark, tag, name) ends one and the next ones still run.
    A job that fails is Error with its message and ends nothing else.
    """
    tag, done, sc = tag or f"batch-{uuid.uuid4().hex}", [], spark.sparkContext
    stopped = _STOPPED.setdefault(tag, set())
    try:
        for name, f in work.items():
            if ALL in stopped:
                done.append((name, "Pending", None))
                continue
            if name in stopped:
                done.append((name, "Cancelled", None))
                continue
            tags = (tag, _job_tag(tag, name))
            for t in tags:
                sc.addJobTag(t)
            try:
                f()
                done.append((name, "Done", None))
            except Exception as e:  # whatever a job raises
                done.append((name, "Cancelled" if stopped & {ALL, name} else "Error", str(e).splitlines()[0][:500] if str(e) else type(e).__name__))
            finally:
                for t in tags:
                    sc.removeJobTag(t)
    finally:
        _STOPPED.pop(tag, None)
    return spark.createDataFrame(done, "job string, status string, error string")


def stop_batch(spark: SparkSession, tag: str) -> None:
    """Ends the running job of a batch, of this driver, and those to come."""
    _STOPPED.setdefault(tag, set()).add(ALL)
    spark.sparkContext.cancelJobsWithTag(tag)


def stop_job(spark: SparkSession, tag: str, name: str) -> None:
    """Ends one job of a batch, whether it runs or is to come."""
    _STOPPED.setdefault(tag, set()).add(name)
    spark.sparkContext.cancelJobsWithTag(_job_tag(tag, name))


def _job_tag(tag: str, name: str) -> str:
    return f"{tag}/{name}".replace(",", ";")  # a tag has no comma


def collisions(outputs: DataFrame, path: str = "output_dir") -> DataFrame:
    """outputs with n_same: jobs that write to the same folder."""
    n = outputs.groupBy(path).agg(F.count("*").alias("n_same"))
    return outputs.join(n, path)


def summary(is_360: Column, pitch: Column, cameras: Column, layout: Column, adaptive: Column, ai_mode: Column) -> Column:
    """Text such as 'High (-20°), 8 cams (Ring) [Adaptive] [AI Mask]'; flat media name neither tilt nor cameras."""
    tilt = F.when(pitch == -20, "High").when(pitch == 20, "Low").otherwise("Std")
    known = F.when(layout.isin("ring", "cube", "fibonacci"), F.concat(F.lit(" ("), F.initcap(layout), F.lit(")"))).otherwise("")
    head = F.when(is_360, F.concat(tilt, F.lit(" ("), pitch.cast("string"), F.lit("°), "), cameras.cast("string"), F.lit(" cams"), known)).otherwise("Flat (Non-360)")
    ai = F.when(ai_mode == "Generate Mask", " [AI Mask]").when(ai_mode == "Skip Frame", " [AI Skip]").otherwise("")
    return F.concat(head, F.when(adaptive, " [Adaptive]").otherwise(""), ai)


def any_needs_detector(jobs: DataFrame, mode: str = "ai_mode") -> DataFrame:
    """One row: whether any job's mode needs a detector; false without jobs."""
    return jobs.agg(F.coalesce(F.bool_or(F.coalesce(F.col(mode), F.lit("None")) != "None"), F.lit(False)).alias("needs_detector"))
