"""Spelling variants against plain Python over all pairs and all texts."""

import random
import re
import zlib
from collections import Counter

import numpy as np

from orbitframe.llm import spelling

LOW = {ord(a): b for a, b in zip(spelling.UPPER, spelling.LOWER)}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(counts, ratio=2):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    best = {w: min(vs, key=lambda v: (-counts[v], v)) if vs else None for w, vs in near.items()}
    form = {w: b if b and counts[b] >= ratio * counts[w] else None for w, b in best.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), counts[w], len(near[w]), counts[form[w]] if form[w] else None) for w in counts}


def plain_counts(docs):
    n = Counter()
    for d, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def test_neighbourhood_is_whole_and_distinct():
    letters = "abé"
    for word in ("a", "aab", "abba", "éaaé"):
        row, h, edit, at, letter = spelling.neighbourhood(spelling._points(word).astype(np.int64)[None], np.array(sorted(map(ord, letters))))
        made = []
        for e, i, c in zip(edit, at, letter):
            made.append(word[:i] + ("" if e == spelling.DELETED else chr(c)) + word[i + (0 if e == spelling.INSERTED else 1) :])
        assert len(made) == len(set(made))
        wanted = {word[:i] + word[i + 1 :] for i in range(len(word))} | {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in letters} | {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in letters}
        assert set(made) == wanted - {word}
        assert [spelling.word_hash(w) for w in made] == h.view(np.int64).tolist()


def test_variants_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(spelling, "CANDIDATES", 64)
    rnd = random.Random(8)
    counts = {}
    for _ in range(150):
        w = "".join(rnd.choice("abcé") for _ in range(rnd.randrange(1, 6)))
        counts[w] = rnd.choice([3, 4, 6, 8, 12, 24, 100])
    counts["z" * 300], counts["z" * 299 + "y"], counts["😀bc"], counts["😀bd"] = 9, 4, 5, 50
    rows = [(w, n, "c") for w, n in counts.items()] + [(None, 5, "c"), ("", 7, "c")]
    rows[0:1] = [(rows[0][0], rows[0][1] - 1, "c"), (rows[0][0], 1, "c")]
    got = {tuple(r) for r in spelling.spelling_variants(spark.createDataFrame(rows, "word string, n long, form string")).collect()}
    assert got == plain(counts)


def test_long_chains_of_forms(spark):
    n = 70
    forms = spark.createDataFrame([(f"w{k}", f"w{k + 1}" if k + 1 < n else None) for k in range(n)] + [("alone", None)], "word string, form string")
    assert {(r.word, r.root) for r in spelling.with_roots(forms).collect()} == {(f"w{k}", f"w{n - 1}") for k in range(n)} | {("alone", "alone")}


def test_empty_tables(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], "word string, n long")).count() == 0
    assert spelling.word_counts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_by_brute_force(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    more = spark.createDataFrame([(1, None, "run"), (None, "Überaus ××××× überaus ÜBERAUS", "word"), (2, "", "n"), (3, "WORDS words Words wordés " * 40, "x")], "doc_id long, text string, lang string")
    src.union(more).write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in spelling.op12_spelling_variants(spark, str(tmp_path)).collect()}
    wanted = plain(plain_counts([(r.doc_id, r.text) for r in src.union(more).collect()]))
    assert got == wanted and any(r[1] for r in wanted) and any(r[1] != r[2] and r[1] for r in wanted)
