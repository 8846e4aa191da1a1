"""Adaptive keyframes over a stream of scores whose rows arrive out of order."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from orbitframe.session import ensure_checkpoint_dir

ROW = "job_id long, event_id long, ts timestamp, score double"
#: Fixed value: the state store that keeps states on the executors' disks and their changes in the checkpoint.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: The number that stands for no job at the end of a stream.
NO_JOB = -(1 << 63)


class Keyframes(StatefulProcessor):
    """State of a job: the score of its last kept row, the rows that wait for the watermark, and the time of its one timer.

    Rows wait until the watermark has passed them, so none that isn't dropped as late can come before them any more; then they are taken in
    order of (ts, event_id). A row is kept if it is the first of its job or differs from the last kept one by more than the threshold.
    """

    def __init__(self, threshold: float):
        self.threshold = threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "score double")
        self.waiting = handle.getListState("waiting", "event_id long, micros long, score double")
        self.timer = handle.getValueState("timer", "ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = []
        for part in rows:
            micros = part["ts"].astype("datetime64[us]").astype("int64")
            new += zip(part["event_id"].tolist(), micros.tolist(), part["score"].tolist())
        if new:
            self.waiting.appendList(new)
            self.wake(min(micros for _, micros, _ in new))
        return iter([])

    def wake(self, micros: int) -> None:
        """The job's one timer is that of its earliest waiting row; whatever else is due then goes with it."""
        ms = micros // 1000 + 1
        held = self.timer.get()[0] if self.timer.exists() else None
        if held is None or ms < held:
            if held is not None:
                self.handle.deleteTimer(held)
            self.handle.registerTimer(ms)
            self.timer.update((ms,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due, later = [], []
        limit = timerValues.getCurrentWatermarkInMs() * 1000
        for event_id, micros, score in self.waiting.get():
            (due if micros < limit else later).append((micros, event_id, score))
        self.timer.clear()
        if later:
            self.waiting.put([(event_id, micros, score) for micros, event_id, score in later])
            self.wake(min(later)[0])
        else:
            self.waiting.clear()
        if not due:
            return iter([])
        last = self.last.get()[0] if self.last.exists() else None
        kept = []
        for micros, event_id, score in sorted(due):
            if last is None or abs(score - last) > self.threshold:
                kept.append((key[0], event_id, micros, score))
                last = score
        self.last.update((last,))
        frame = pd.DataFrame(kept, columns=["job_id", "event_id", "ts", "score"])
        return iter([frame.astype({"job_id": "int64", "event_id": "int64", "score": "float64"}).assign(ts=pd.to_datetime(frame["ts"], unit="us"))])

    def close(self) -> None:
        pass


def keyframe_stream(scores: DataFrame, threshold: float, delay: str = "10 minutes") -> DataFrame:
    """Kept rows (ROW) of a streaming frame of these columns, without null jobs and scores; rows later than ``delay`` behind the newest are dropped.

    Rows newer than the watermark wait for it; what waits is all that a job's state grows with. Run it with RocksDB states (rocksdb_states).
    """
    rows = scores.where("job_id is not null and event_id is not null and score is not null").withWatermark("ts", delay)
    return rows.groupBy("job_id").transformWithStateInPandas(Keyframes(threshold), ROW, "Append", "EventTime")


def run_to_end(spark: SparkSession, scores: DataFrame, threshold: float, delay: str = "10 minutes") -> DataFrame:
    """All rows that keyframe_stream gives for the input at hand, as if nothing came after it, by files in the shared folder.

    The stream runs until the input is used up; then, from the same checkpoint, it gets a row of NO_JOB far in the future, after which nothing has to
    wait. That row itself never comes out.
    """
    folder = os.path.join(ensure_checkpoint_dir(spark), f"keyframes-{uuid.uuid4().hex}")
    end = spark.range(1).select(F.lit(NO_JOB).cast("long").alias("job_id"), F.lit(0).cast("long").alias("event_id"), F.lit("2200-01-01").cast("timestamp").alias("ts"), F.lit(0.0).alias("score"))
    out = None
    for rows in (end.limit(0), end):
        rows.write.mode("append").parquet(f"{folder}/end")
        out = keyframe_stream(scores.unionByName(spark.readStream.schema(end.schema).parquet(f"{folder}/end")), threshold, delay)
        with rocksdb_states(spark):
            query = out.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/rows")


@contextmanager
def rocksdb_states(spark: SparkSession):
    """Streams that start inside keep their states in RocksDB."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
