import hashlib
import random

import duckdb
from pyspark.sql import functions as F

from orbitframe.llm import winnowing
from orbitframe.llm.winnowing import edited_likeness, op8_winnowing, winnow, with_next

K, W = 8, 16


def grams_of(spark, texts):
    """XXH64 of all grams, by Spark: the hash is a fixed function, what is tested is the selection."""
    every = sorted({t[i : i + K] for t in texts for i in range(max(1, len(t) - K + 1)) if t})
    rows = spark.createDataFrame([(g,) for g in every], "g string").select("g", F.xxhash64("g").alias("h")).collect() if every else []
    return {r.g: (r.h & (1 << 63) - 1) >> 32 for r in rows}


def plain(text, hashes):
    """(position, hash) of the rightmost least gram of every window, once each."""
    if not text:
        return []
    h = [hashes[text[i : i + K]] for i in range(max(1, len(text) - K + 1))]
    out = []
    for s in range(max(1, len(h) - W + 1)):
        window = range(s, min(len(h), s + W))
        least = min(h[j] for j in window)
        at = max(j for j in window if h[j] == least)
        if not out or out[-1] != (at, least):
            out.append((at, least))
    return out


TEXTS = ["the quick brown fox jumps over the lazy dog again and again", "short", "", "a" * 60, "𝔘𝔫𝔦 ünï " * 9, "x" * 8, "exactly23codepointslong", "日本語" * 20, "line\nfeeds\nare\ncode\npoints\r\ntoo"]


def test_selection_by_plain_windows(spark):
    hashes = grams_of(spark, TEXTS)
    df = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(TEXTS)] + [(None, None, "kept")], "id long, text string, packed string")
    got = winnow(df, "text", "w").collect()
    assert len(got) == len(TEXTS) + 1 and all(r.packed == "kept" for r in got)
    for r in got:
        assert [tuple(x) for x in r.w] == plain(r.text, hashes)
    assert winnow(df.limit(0), "text", "w").count() == 0


def test_match_guarantee_in_text_without_spaces(spark):
    rng = random.Random(5)
    base = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(2_000))
    rows = [(0, base), (1, "x" + base), (2, base[700:723]), (3, "##" + base[900:950] + "##")]
    got = {r.id: {x.hash for x in r.w} for r in winnow(spark.createDataFrame(rows, "id long, text string"), "text", "w").collect()}
    assert len(got[0] & got[1]) >= 0.98 * len(got[0])
    assert got[2] & got[0] and got[3] & got[0]


def plain_query(docs, hashes):
    order = sorted(docs, key=lambda i: -i)
    out = {}
    for n, i in enumerate(order):
        t, following = docs[i] or "", docs[order[(n + 1) % len(order)]] or ""
        m = len(t) // 3
        edited = t[: len(t) - m] + following[:m]
        sets = [{h for _, h in plain(x, hashes)} for x in (t, edited, following)]
        like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        out[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), like(sets[0], sets[1]), like(sets[0], sets[2]), edited)
    return out


def test_whole_query_by_plain_version(spark):
    sf = "/root/testdata/sf0.001"
    docs = dict(duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall())
    edited = [x[4] for x in plain_query(docs, _Any()).values()]
    hashes = grams_of(spark, [t or "" for t in docs.values()] + edited)
    want = plain_query(docs, hashes)
    rows = op8_winnowing(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n, sha, near_edited, near_next, _ = want[r.doc_id]
        assert (r.n_chars, r.edited_sha256) == (n, sha)
        assert abs(r.near_edited - near_edited) < 1e-12 and abs(r.near_next - near_next) < 1e-12
    prints = {}
    for r in rows:
        prints.setdefault(docs[r.doc_id] or "", set()).add(r.fingerprint)
    assert all(len(x) == 1 for x in prints.values())


class _Any(dict):
    """Any gram's hash, where only texts are asked for."""

    def __missing__(self, key):
        return 0


def test_next_over_many_parts_and_hot_ids(spark, monkeypatch):
    monkeypatch.setattr(winnowing, "PART_ROWS", 20)
    rng = random.Random(1)
    ids = [None] * 150 + [7] * 150 + rng.sample(range(100, 10**6), 200) + [-5]
    rows = [(i, rng.randrange(-(1 << 63), 1 << 63), k) for k, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "id long, th long, k long")
    got = {r.k: r.next_k for r in with_next(df, "id", "th", "k").collect()}
    order = [k for i, th, k in sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(1 << 63)), r[1]))]
    assert got == {k: order[(n + 1) % len(order)] for n, k in enumerate(order)}
    one = spark.createDataFrame([(1, 5, 9)], "id long, th long, k long")
    assert with_next(one, "id", "th", "k").first().next_k == 9
    assert with_next(one.limit(0), "id", "th", "k").count() == 0


def test_edge_cases(spark):
    rows = [(1, "same text here, long enough", "x"), (1, "same text here, long enough", "x"), (None, None, "x"), (None, "", "x"), (2, "y" * 50_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, packed string")
    got = edited_likeness(df).collect()
    assert len(got) == 5 and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert len({r.fingerprint for r in got if r.id == 1}) == 1
    assert edited_likeness(df.limit(0)).count() == 0
