"""Values on the limit of a rounding or of a filter: as plain SQL has them."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from orbitframe.operators import frames as fr
from orbitframe.plans import extraction as ex
from orbitframe.streaming import smart_blur


def test_rounding_as_sql_has_it(spark):
    got = spark.createDataFrame([(8.1375,), (2.0075,), (1.0005,), (59.6425,), (-8.1375,), (0.0625,)], "x double").select(ex.decimals(F.col("x"), 3).alias("r"))
    assert [r.r for r in got.collect()] == [8.137, 2.007, 1.001, 59.643, -8.137, 0.063]


@pytest.mark.parametrize("streamed", [False, True])
def test_scores_on_the_limit_of_smart_blur(spark, tmp_path, streamed):
    # 0.6 of the mean of the first six is 31.59 by a corrected sum, a little more by a plain one.
    scores = [52.76, 41.91, 54.37, 55.58, 59.97, 51.31, 31.59]
    rows = [(1, k, datetime(2024, 1, 1, 0, k), x) for k, x in enumerate(scores)]
    df = spark.createDataFrame(rows, "job_id long, event_id long, ts timestamp, score double")
    if streamed:
        df.write.parquet(str(tmp_path / "in"))
        got = smart_blur.run_available(spark, smart_blur.smart_blur_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), 20.0))
    else:
        got = fr.smart_blur(df, 20.0, order=("event_id",))
    assert sorted(r.event_id for r in got.collect()) == [0, 1, 2, 3, 4, 5]
