"""Periodic runs against a plain search of every stretch, and the query against plain Python."""

import hashlib
import random
import zlib

import numpy as np

from orbitframe.llm import runs

SCHEMA = "doc_id long, text string, runs string, period string"


def plain_runs(w, least=6, times=4):
    found = {}
    n = len(w)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q) and (i, j + q) not in found:
                found[i, j + q] = q
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def plain_row(doc_id, text):
    w = (text or "").encode().split()
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    found = plain_runs(w)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found).encode()
    return (doc_id, len(found), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4), sha(lines), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_runs_by_brute_force():
    rnd = random.Random(3)
    docs = []
    for _ in range(300):
        n, kinds = rnd.randrange(0, 90), rnd.randrange(1, 4)
        d = [rnd.randrange(kinds) for _ in range(n)]
        if n > 20 and rnd.random() < 0.6:
            a, p = rnd.randrange(n // 2), rnd.randrange(1, 7)
            d[a:] = [d[a + (i - a) % p] for i in range(a, n)]
        docs.append(d)
    for least, times in ((6, 4), (2, 2), (9, 3)):
        got = runs.find_runs([np.array(d, np.int64) for d in docs], least, times)
        assert [list(map(tuple, g.tolist())) for g in got] == [plain_runs(d, least, times) for d in docs]


def test_extensions_by_brute_force():
    rnd = random.Random(4)
    x = np.array([9, *(rnd.randrange(2) for _ in range(400)), 10])
    ext = runs.Extensions(x)
    a, b = np.array([(i, j) for i in range(1, 200, 7) for j in range(2, 400, 5) if i != j]).T
    forward = [next(k for k in range(999) if j + k >= len(x) or i + k >= len(x) or x[i + k] != x[j + k]) for i, j in zip(a, b)]
    back = [next(k for k in range(999) if i - 1 - k < 0 or j - 1 - k < 0 or x[i - 1 - k] != x[j - 1 - k]) for i, j in zip(a, b)]
    assert ext.forward(a, b).tolist() == forward
    assert ext.backward(a, b).tolist() == back


def test_queries_in_small_parts(monkeypatch):
    monkeypatch.setattr(runs, "QUERIES", 7)
    d = np.array([0, 1] * 40 + [2] * 9 + list(range(5)) * 4)
    assert list(map(tuple, runs.find_runs([d, d[::-1].copy()])[0].tolist())) == plain_runs(d.tolist())


def test_texts_of_all_kinds(spark):
    rows = [(1, None, "r", "p"), (None, "", "r", "p"), (3, " \n\t", "r", "p"), (4, "a\x0bb " * 5, "r", "p"), (4, "a\x0bb " * 5, "r", "p"), (5, "no no no no no no yes yes", "r", "p"), (6, "x y " * 60_000, "r", "p")]
    got = {(r.id, r.n_words, tuple(map(tuple, r.runs)), r.text) for r in runs.periodic_runs(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {
        (1, 0, (), ""), (None, 0, (), ""), (3, 0, (), ""), (4, 10, ((0, 10, 2),), "a b"), (5, 7, ((0, 6, 1),), "no yes yes"), (6, 120_000, ((0, 120_000, 2),), "x y"),
    }
    assert runs.periodic_runs(spark.createDataFrame(rows, SCHEMA)).count() == 7
    assert runs.periodic_runs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_by_brute_force(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(10**6, None), (10**6 + 4, ""), (10**6 + 6, "a b a b a b a b"), (None, "z " * 20)] + [(10**7 + k, "w%d v u" % (k % 3) * (k % 50)) for k in range(300)], "doc_id long, text string")
    src.union(more).write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r)[:8] for r in runs.op13_periodic_runs(spark, str(tmp_path)).collect()}
    wanted = {plain_row(r.doc_id, r.text) for r in src.union(more).collect()}
    assert got == wanted
    assert sum(1 for r in wanted if r[1]) > 20
