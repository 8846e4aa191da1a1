import duckdb
import hashlib
import re

import corpus_pipeline as cp
from brute import components, simhash
from orbitframe.llm.toxicity import THRESHOLD, toxicity_scores
from test_lines_mixing import deduped

SF = "/root/testdata/sf0.01"


def texts(df):
    return [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in df.collect()]


def test_stages_by_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = dict(duckdb.sql(f"select doc_id, toxic from '{SF}/labels.parquet'").fetchall())

    def step(k, df):
        out = cp.STAGES[k][1](spark, df, SF)
        if k < 4:
            assert tuple(out.columns) == cp.COLUMNS
        out.write.parquet(str(tmp_path / f"{k}"))
        return spark.read.parquet(str(tmp_path / f"{k}"))

    scores = {r.id: r.score for r in toxicity_scores(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    clean = step(0, docs)
    kept = {r[0] for r in texts(clean)}
    assert kept == {i for i, s in scores.items() if s < THRESHOLD}
    assert sum(1 for i in kept if labels.get(i) == 0) >= 0.95 * sum(1 for v in labels.values() if v == 0)

    lines = step(1, clean)
    want = deduped({i: t for i, t, *_ in texts(clean)})
    want = {i: t for i, (t, n, gone) in want.items() if not gone or gone < n}
    assert {i: t for i, t, *_ in texts(lines)} == want
    assert all(n == len(t or "") for _, t, _, _, n in texts(lines))

    single = step(2, lines)
    fp = {i: simhash(t) for i, t in want.items()}
    comp = components(fp, lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 4)
    assert {r[0] for r in texts(single)} == {i for i in comp if comp[i] == i}

    mixed = step(3, single)
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t, *_ in texts(single)}
    times = {}
    for i, *_ in texts(mixed):
        times[i] = times.get(i, 0) + 1
    assert set(times) <= set(size) and max(times.values()) <= 3
    total = sum(size.values())
    assert 0.99 * total <= sum(size[i] * n for i, n in times.items()) <= total

    done = step(4, mixed)
    source = {i: t for i, t, *_ in texts(mixed)}
    rows = done.collect()
    assert sorted(r.doc_id for r in rows) == sorted(i for i, *_ in texts(mixed))
    for r in rows:
        data = source[r.doc_id].encode()
        assert b"".join(data[a:b] for a, b in zip(r.piece_starts, r.piece_ends)) == data
        assert r.decoded_sha256 == hashlib.sha256(data).hexdigest()


def test_run_gives_the_last_stage(spark):
    sf = "/root/testdata/sf0.001"
    out = cp.run(spark, sf)
    assert out.columns[0] == "doc_id" and out.count() > 0
    assert 4 <= len(cp.STAGES) <= 5


def test_mix_stage_with_repeated_and_null_rows(spark):
    rows = [(1, "a b", "x", "s", 3), (1, "a b", "x", "s", 3), (1, "a b c", "x", None, 5), (None, "d e", None, "s", 3), (None, "f", "x", "s", 1), (2, None, "x", "s", None), (3, "", "x", "t", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {}
    for r in cp.mix_sources(spark, docs, SF).collect():
        got[tuple(r)] = got.get(tuple(r), 0) + 1
    assert got and all(n <= 3 * rows.count(r) for r, n in got.items()) and {r for r in got} <= {r for r in rows if r[1]}
    assert cp.mix_sources(spark, docs.limit(0), SF).count() == 0


def test_dedup_stages_with_repeated_and_null_ids(spark):
    t, u = "one two three four five six", "seven eight nine ten eleven twelve"
    rows = [(1, t, "x", "s", 1), (1, t, "x", "s", 1), (1, t, "y", "s", 1), (None, t, "x", "s", 1), (None, u, "x", "s", 1), (None, u, "x", "s", 1), (7, None, "x", "s", 0), (7, "", "x", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text or "") for r in cp.drop_near_copies(spark, docs, SF).collect()]
    assert sorted(got, key=repr) == sorted([(1, t), (None, u), (7, "")], key=repr)
    assert cp.drop_near_copies(spark, docs.limit(0), SF).count() == 0
    lines = spark.createDataFrame([(None, "a\nb\nc\nd", "x", "s", 7), (None, "z\na\nb\nc", "x", "s", 7), (None, "q", "x", "s", 1)], docs.schema)
    left = sorted(r.text for r in cp.drop_lines(spark, lines, SF).collect())
    assert left in (["a\nb\nc\nd", "q", "z"], ["d", "q", "z\na\nb\nc"])


def test_toxic_documents_go_whatever_the_columns(spark):
    from orbitframe.llm import toxicity
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(docs, labels)
    more = docs.select("doc_id", "text")
    for name in ("lang-code", "a.b", "x", "row", "score", "margin", "features", "label"):
        more = more.withColumn(name, F.lit("kept"))
    more = more.union(spark.createDataFrame([(None, None), (1, ""), (1, "")], "doc_id long, text string").select("doc_id", "text", *[F.lit("kept")] * 8))
    kept = model.keep(more, toxicity.THRESHOLD)
    assert kept.columns == more.columns and {tuple(r)[2:] for r in kept.collect()} == {("kept",) * 8}
    scores = {r.id: r.score for r in model.score(docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))).collect()}
    want = sorted(i for i, x in scores.items() if x < toxicity.THRESHOLD)
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None and r.text) == want and len(want) < len(scores)
    assert model.keep(more.limit(0), toxicity.THRESHOLD).count() == 0
