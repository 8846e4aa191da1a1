import duckdb
import pytest

from orbitframe.plans import file_queries  # noqa: F401
from orbitframe.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "customer supplier part orders lineitem events embeddings pages".split()


def plain(v):
    return float(f"{v:.9g}") + 0.0 if isinstance(v, float) else v


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", QUERIES)
def test_query_against_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    rel = db.sql(SQL[name])
    assert sorted(rel.columns) == sorted(df.columns)
    at = [rel.columns.index(c) for c in df.columns]
    got = sorted((tuple(map(plain, r)) for r in df.collect()), key=repr)
    want = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    assert got == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
