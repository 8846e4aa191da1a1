import duckdb
import pytest
from pyspark.sql import functions as F

from orbitframe.llm.lines import OP5_SQL, line_dedup, op5_line_dedup
from orbitframe.llm.mixing import OP6_SQL, mix, op6_source_mixing, source_targets

SF = "/root/testdata/sf0.001"


def sql_rows(sql, columns, **tables):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    rel = con.sql(sql)
    at = [rel.columns.index(c) for c in columns]
    return sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=repr)


@pytest.mark.parametrize("f, sql", [(op5_line_dedup, OP5_SQL), (op6_source_mixing, OP6_SQL)])
def test_whole_query_against_sql(spark, f, sql):
    df = f(spark, SF)
    got = sorted((tuple(r[c] for c in df.columns) for r in df.collect()), key=repr)
    assert got == sql_rows(sql, df.columns)


def deduped(docs, span=3):
    """Plain version for unique ids."""
    seen, out = {}, {}
    for i, t in sorted((x for x in docs.items() if x[1] is not None)):
        lines, gone = t.split("\n"), set()
        for p in range(len(lines) - span + 1):
            w = tuple(lines[p : p + span])
            if w in seen:
                gone.update(range(p, p + span))
            else:
                seen[w] = (i, p)
        out[i] = ("\n".join(x for k, x in enumerate(lines) if k not in gone), len(lines), len(gone))
    return out


def test_line_dedup_by_brute_force(spark):
    import random

    rng = random.Random(1)
    docs = {i: "\n".join(rng.choice("abc") for _ in range(rng.randrange(0, 14))) for i in range(80)}
    docs |= {100: None, 101: "", 102: "x\n" * 5000 + "end"}
    df = spark.createDataFrame([(i, t, 7) for i, t in docs.items()], "doc_id long, text string, n_lines int").withColumn("first", F.lit(1))
    got = {r.doc_id: r for r in line_dedup(df).collect()}
    want = deduped(docs)
    assert {i: (r.text, r.n_lines, r.n_removed) for i, r in got.items() if i != 100} == want
    assert (got[100].text, got[100].n_lines, got[100].n_removed) == (None, 0, 0)
    assert got[1].first == 1
    assert line_dedup(df.limit(0)).count() == 0


def test_line_dedup_null_and_repeated_ids(spark):
    t = "a\nb\nc\nd"
    df = spark.createDataFrame([(None, t), (None, "z\n" + t), (5, t), (5, t), (6, "q\n" + t)], "doc_id long, text string")
    got = sorted(((r.doc_id or -1), r.text) for r in line_dedup(df).collect())
    assert got == [(-1, ""), (-1, "z"), (5, t), (5, t), (6, "q")]


def shares(sizes, weights, epochs=3):
    """Targets by sharing again and again."""
    total, capped = sum(sizes), set()
    while True:
        left = total - sum(epochs * sizes[i] for i in capped)
        w = sum(weights[i] for i in range(len(sizes)) if i not in capped)
        t = [epochs * s if i in capped else (left * weights[i] / w if w else 0) for i, s in enumerate(sizes)]
        new = {i for i in range(len(sizes)) if i not in capped and t[i] > epochs * sizes[i]}
        if not new:
            return t
        capped |= new


def test_targets_by_sharing_again(spark):
    cases = [[1, 1, 100, 5, 7], [10], [0, 5, 0], [3, 1000, 2, 2, 2, 2], [5, 5, 5, 5, 5, 5, 90]]
    for sizes in cases:
        df = spark.createDataFrame([(f"s{i:02d}", s) for i, s in enumerate(sizes)], "src string, size long")
        got = {r.src: r.target for r in source_targets(df).collect()}
        want = shares(sizes, [i % 3 + 1 for i in range(len(sizes))])
        assert [got[f"s{i:02d}"] for i in range(len(sizes))] == pytest.approx(want)


def test_mix_meets_targets_and_agrees(spark):
    rows = [(i, "w " * (i % 40), None if i % 9 == 0 else f"s{i % 4 if i % 3 else 0}", 1.0) for i in range(1500)] + [(None, None, "s1", 1.0), (None, "a b", "s1", 1.0), (7, "w " * 7, "s1", 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, target double")
    a = mix(df).collect()
    assert sorted(map(repr, a)) == sorted(map(repr, mix(df.repartition(5)).collect()))
    assert len(a) == len(rows)
    by = {}
    for r in a:
        assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        t, g = by.get(r.src, (r.target, 0))
        by[r.src] = (t, g + r.taken)
    assert all(abs(t - g) <= 40 for t, g in by.values())
    assert sum(g for _, g in by.values()) <= sum(r.size for r in a)
    assert mix(df.limit(0)).count() == 0
    assert {(r.taken, r.target) for r in mix(df.where("size(split(text,' ')) < 2")).collect()} <= {(0, 0.0)}
