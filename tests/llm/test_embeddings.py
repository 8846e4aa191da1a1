import random

import duckdb

from brute import cosine_links
from orbitframe.llm.embeddings import op9_embedding_near_dedup, similar_vectors


def test_whole_query_recall(spark):
    sf = "/root/testdata/sf0.01"
    vectors = dict(duckdb.sql(f"select vec_id, embedding from '{sf}/embeddings.parquet'").fetchall())
    n, comp = cosine_links(vectors)
    got = {r.vec_id: r for r in op9_embedding_near_dedup(spark, sf).collect()}
    assert set(got) == set(vectors)
    assert all(got[i].n_links <= n[i] for i in n)
    assert {i: (r.n_links, r.component_id) for i, r in got.items()} == {i: (n[i], comp[i]) for i in n}
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_exact_with_many_cells(spark, monkeypatch):
    import orbitframe.llm.embeddings as e

    monkeypatch.setattr(e, "CELL_ROWS", 20)
    rng = random.Random(5)
    vectors = {}
    for k in range(60):
        base = [rng.gauss(0, 1) for _ in range(8)]
        for _ in range(5):
            vectors[len(vectors)] = [x + rng.gauss(0, 0.25) for x in base]
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    n, comp = cosine_links(vectors)
    got = {r.id: (r.n_links, r.component) for r in similar_vectors(df, margin=None).collect()}
    assert got == {i: (n[i], comp[i]) for i in vectors}


def test_production_setting_on_a_flat_hot_cluster(spark, monkeypatch, tmp_path):
    import numpy as np

    import orbitframe.llm.embeddings as e

    monkeypatch.setattr(e, "CELL_ROWS", 75)
    rng = np.random.default_rng(4)
    directions = np.linalg.qr(rng.normal(size=(64, 3)))[0].T
    hot = rng.normal(size=64) / 8 + rng.normal(size=(300, 3)) * 0.5 @ directions
    vectors = dict(enumerate([*hot.tolist(), *rng.normal(size=(300, 64)).tolist()]))
    spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    n, comp = cosine_links(vectors)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in op9_embedding_near_dedup(spark, str(tmp_path)).collect()}
    assert sum(n.values()) > 2000 and got == {i: (n[i], comp[i], comp[i] == i) for i in vectors}


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    v = {1: None, 2: [], 3: [0.0, 0.0], 4: [nan, 1.0], 5: [inf, 1.0], 6: [None, 1.0], 7: [1.0, 0.0], 8: [2.0, 0.1], 9: [1.0, 0.0], 10: [1.0, 0.0, 0.0], 11: [-1.0, 0.0], 12: [1e300, 1e299], 13: [5.0, 0.0, 0.0]}
    df = spark.createDataFrame([(*x, "a") for x in v.items()], "vec_id long, embedding array<double>, component string")
    n, comp = cosine_links(v)
    got = {r.id: (r.n_links, r.component, r.kept) for r in similar_vectors(df).collect()}
    assert got == {i: (n[i], comp[i], comp[i] == i) for i in v}
    assert similar_vectors(df.limit(0)).count() == 0
    assert similar_vectors(df.where("vec_id < 4")).count() == 3


def test_sql_says_the_same(spark, tmp_path):
    from orbitframe.llm.embeddings import OP9_SQL

    rng = random.Random(3)
    rows = []
    for k in range(40):
        base = [rng.gauss(0, 1) for _ in range(6)]
        rows += [(len(rows) + j, [x + rng.gauss(0, 0.2) for x in base]) for j in range(4)]
    rows += [(200, None), (201, [0.0] * 6), (202, [float("nan")] + [1.0] * 5), (203, [None] + [1.0] * 5), (204, rows[0][1]), (205, [1.0, 2.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted(con.sql(OP9_SQL).fetchall(), key=repr)
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in op9_embedding_near_dedup(spark, str(tmp_path)).collect()), key=repr)
    assert got == want and sum(r[1] for r in want) > 100


def test_large_blocks_of_links(spark):
    """A group of near copies so large that its products are decided densely."""
    rng = random.Random(6)
    base = [rng.gauss(0, 1) for _ in range(4)]
    vectors = {i: [x + rng.gauss(0, 0.3) for x in base] for i in range(400)}
    n, comp = cosine_links(vectors)
    got = {r.id: (r.n_links, r.component) for r in similar_vectors(spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")).collect()}
    assert sum(n.values()) > 40_000 and got == {i: (n[i], comp[i]) for i in vectors}
