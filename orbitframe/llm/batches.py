"""Arrow batches of texts, bounded by bytes: texts of one table differ in length by orders of magnitude."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: Rows and bytes of a batch that Spark sends to a worker, and bytes that a worker turns into Python objects at once.
BATCH_ROWS, BATCH_BYTES, PART_BYTES = 1_000, 4 << 20, 1 << 18


def bound_batches(spark: SparkSession) -> None:
    """Set the session's limits of Arrow batches to BATCH_ROWS and BATCH_BYTES, where they are wider or not set."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key, None)
        if not (now and now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))


def text_parts(batch: pa.RecordBatch, column: int, most: int = PART_BYTES) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) of runs of rows of about ``most`` bytes of text; a longer text is a run of its own."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        done = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, done + most, side="right")))
        yield at, batch.column(column).slice(at, to - at).to_pylist()
        at = to
