import random

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

from brute import components, simhash
from orbitframe.llm.simhash import HALVES, THIRDS, fingerprint, linked_fingerprints, near_dedup, op3_simhash_near_dedup, simhash_groups

SF = "/root/testdata/sf0.001"


def test_fingerprint_matches_plain_loop():
    texts = [None, "", " \t\n", "One", "a b c", "A b C d e a b c d e", "É ÀB c d  e f\x0bg", "x " * 500, "the Quick brown fox\r\njumps over the lazy dog"]
    for t in texts:
        assert fingerprint(t) == simhash(t), t
    assert fingerprint("Abc") == xxhash.xxh64(b"abc", seed=42).intdigest()


def test_whole_query_against_all_pairs(spark):
    docs = dict(duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall())
    fp = {i: simhash(t) for i, t in docs.items()}
    want = components(docs, lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 4)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op3_simhash_near_dedup(spark, SF).collect()}
    assert got == {i: (f"{fp[i]:016x}", want[i]) for i in docs}


@pytest.mark.parametrize("segments", [None, THIRDS, HALVES])
def test_links_of_random_near_fingerprints(spark, segments):
    rng = random.Random(3)
    fps = set()
    for _ in range(40):
        base = rng.getrandbits(64)
        for _ in range(6):
            x = base
            for b in rng.sample(range(64), rng.randrange(0, 6)):
                x ^= 1 << b
            fps.add(x - (1 << 64) if x >> 63 else x)
    want = components(sorted(fps), lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4)
    got = {r.fp: r.comp for r in linked_fingerprints(spark.createDataFrame([(x,) for x in fps], "fp long"), segments=segments).collect()}
    assert {frozenset(k for k in got if got[k] == c) for c in got.values()} == {frozenset(k for k in want if want[k] == c) for c in want.values()}


def test_edge_cases(spark):
    rows = [(3, None, 1), (2, "", 1), (2, "", 1), (None, "only here now", 1), (9, "only here now", 1), (5, "w " * 60_000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component long").withColumn("fp", F.lit("x"))
    got = sorted((r.id is None, r.id, r.component) for r in simhash_groups(df).collect() if r.id is not None)
    assert got == [(False, 2, 2), (False, 2, 2), (False, 3, 2), (False, 5, 5), (False, 9, 9)]
    assert [r.component for r in simhash_groups(df).where("id is null").collect()] == [9]
    kept = near_dedup(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [2, 2, 5, 9]
    assert simhash_groups(df.limit(0)).count() == 0


def test_rows_of_a_very_common_key_are_spread(spark):
    from pyspark.sql import functions as F

    from orbitframe.llm.blocks import join_spread

    rows = spark.createDataFrame([(i, 7 if i % 2 else (None if i % 5 == 0 else i)) for i in range(3000)], "id long, fp long")
    table = rows.where("fp is not null").groupBy("fp").agg(F.count("*").alias("n"), F.min("id").alias("first")).where("fp % 10 <> 6")
    got = {r.id: r.first for r in join_spread(rows, table, "fp", "n", "id").collect()}
    want = {}
    for i in range(3000):
        fp = 7 if i % 2 else (None if i % 5 == 0 else i)
        want[i] = None if fp is None or fp % 10 == 6 else 1 if fp == 7 else i
    assert got == want
    assert join_spread(rows, table.limit(0), "fp", "n", "id").where("first is not null").count() == 0


def test_near_dedup_with_clashing_names(spark):
    from pyspark.sql import functions as F

    rows = [(1, "a b c d e f", 7), (2, "a b c d e f", 7), (None, "x", 7), (3, None, 7), (4, "", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, gone long")
    for name in ("_gone", "row", "id", "component", "lang-code", "a.b"):
        df = df.withColumn(name, F.lit(1))
    kept = near_dedup(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [1, 3]
    assert near_dedup(df.limit(0)).count() == 0
