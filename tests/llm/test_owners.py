"""Exact duplicates by tries against grouping by plain dictionaries."""

import hashlib
import random

import duckdb
import pytest

from orbitframe.llm import owners

SCHEMA = "doc_id long, text string, owner string, n string"


def plain(rows, largest):
    groups = {}
    for i, (d, t, *_) in enumerate(rows):
        groups.setdefault((t or "").encode().lower(), []).append((d is None, 0 if d is None else -d if largest else d, i))
    out = []
    for text, members in groups.items():
        lost, best, at = min(members)
        for m in members:
            out.append((rows[m[2]][0], None if lost else abs(best), len(members), m[2] == at, hashlib.sha256(text).hexdigest()))
    return out


def some_rows(n=300, seed=5):
    rnd = random.Random(seed)
    stems = ["", None, "a", "A", "ab", "aB", "abc", "É", "é", "x" * 50_000, "X" * 50_000 + "y", " ", "\n"]
    stems += ["".join(rnd.choice("abAB") for _ in range(rnd.randrange(1, 9))) * rnd.randrange(1, 40) for _ in range(60)]
    rows = [(rnd.choice([None, *range(40)]), rnd.choice(stems), "o", "n") for _ in range(n)]
    return rows + rows[:10]


@pytest.mark.parametrize("limit", [owners.TRIE_BYTES, 3_000, 1])
@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_groups_by_brute_force(spark, keep, limit):
    rows = some_rows(300 if limit > 1 else 60)
    got = owners.exact_groups(spark.createDataFrame(rows, SCHEMA).repartition(3), keep=keep, limit=limit).collect()
    wanted = plain(rows, keep == "largest")
    # Of rows of one id, which stays is up to the row key; how many stay isn't.
    key = lambda r: (r[4], str(r[0]), str(r[1]), r[2])
    assert sorted(map(key, got)) == sorted(map(key, wanted))
    assert {r.sha256 for r in got if r.kept} == {r[4] for r in wanted}
    assert sum(r.kept for r in got) == len({r[4] for r in wanted})
    assert all(r.id == r.keep_id for r in got if r.kept)


def test_one_text_in_all_partitions(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "case when id % 3 = 0 then repeat('Same ', 400) else concat('t', id) end as text").repartition(16)
    got = owners.exact_groups(docs, keep="largest").groupBy("group_size").count().collect()
    assert {(r.group_size, r["count"]) for r in got} == {(1334, 1334), (1, 2666)}


def test_empty_table(spark):
    assert owners.exact_groups(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    got = {tuple(r) for r in owners.op11_exact_dedup(spark, sf).collect()}
    with duckdb.connect() as con:
        con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
        assert got == set(con.execute(owners.OP11_SQL).fetchall())


def test_trie_holds_prefixes_and_stubs():
    t = owners.Trie(10**9, True)
    for k, text in enumerate([b"abc", b"abd", b"ab", b"", b"abc", b"abcdef"]):
        t.insert(text, (False, k, k), 1, k)
    assert {s: v[1] for s, v in t.strings()} == {b"abc": 2, b"abd": 1, b"ab": 1, b"": 1, b"abcdef": 1}
    assert t.bytes == len(b"ab" + b"c" + b"d" + b"def")
    t.limit = 4
    gone = dict(t.overflow())
    left = dict(t.strings())
    assert gone and t.bytes <= 4 and not gone.keys() & left.keys() and len(gone) + len(left) == 5
    assert all(t.insert(s, (False, 9, 9), 1, 9) is None for s in gone)
