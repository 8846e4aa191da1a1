"""Session helpers shared by the package."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | None = None, app: str = "orbitframe") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own session."""
    n = cores or os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", n)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows and bytes of an Arrow batch of images.
IMAGE_ROWS, IMAGE_BYTES = 256, 32 << 20


def bound_image_batches(spark: SparkSession) -> None:
    """Set the session's limits of Arrow batches to IMAGE_ROWS and IMAGE_BYTES where they are wider or not set: an image may have a hundred megabytes."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", IMAGE_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", IMAGE_BYTES)):
        now = spark.conf.get(key, None)
        if not (now and now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one only on a local master.

    Raises on a cluster without that setting, because a folder of the driver's machine is no
    place for data that executors must read again.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    wanted = spark.conf.get("spark.checkpoint.dir", None)
    if not wanted:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        wanted = tempfile.mkdtemp(prefix="orbitframe-checkpoint-")
    sc.setCheckpointDir(wanted)
    return wanted


def written_table(df: DataFrame) -> DataFrame:
    """The same rows from a Parquet table in the shared checkpoint folder: smaller than a checkpoint where rows hold texts."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """The same rows from files in the shared checkpoint folder; survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
