"""The smart blur filter over a stream of scores."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from orbitframe.operators.frames import plain_mean
from orbitframe.session import ensure_checkpoint_dir


def smart_blur_stream(scores: DataFrame, floor: float, factor: float = 0.6, history: int = 10, patience: int = 5) -> DataFrame:
    """Accepted rows (job_id, event_id, ts, score) of a streaming frame of these columns.

    State per job: the last accepted scores and the number dropped in a row. Rows of a micro-batch are
    put in order of (ts, event_id) for each job; batches must come in time order, since state
    can't go back.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent, skips = ([*state.get[0]], state.get[1]) if state.exists else ([], 0)
        rows = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        keep = []
        for score in rows.score:
            blurry = score < floor or (recent and score < factor * plain_mean(recent))
            skips = skips + 1 if blurry else 0
            accepted = not blurry or skips > patience
            if accepted:
                skips, recent = 0, [*recent, score][-history:]
            keep.append(accepted)
        state.update((recent, skips))
        yield rows[keep]

    return scores.groupBy("job_id").applyInPandasWithState(step, "job_id long, event_id long, ts timestamp, score double", "recent array<double>, skips int", "append", GroupStateTimeout.NoTimeout)


def run_available(spark: SparkSession, out: DataFrame) -> DataFrame:
    """All rows that a streaming frame gives for the input at hand, by files in the shared folder."""
    folder = os.path.join(ensure_checkpoint_dir(spark), f"stream-{uuid.uuid4().hex}")
    query = out.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/rows")


def event_scores(spark: SparkSession, folder: str, name: str = "events.parquet") -> DataFrame:
    """A streaming frame of the events that land in a folder, as scores (job_id, event_id, ts, score)."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    return e.select(F.col("user_id").alias("job_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("score"))
