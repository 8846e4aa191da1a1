"""Spelling variants: full neighbourhoods of words, met with the vocabulary in a hash join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from orbitframe.session import cut_lineage, read_table, written_table

#: Bits of the vocabulary's filter: so many a word, at least and at most (128 MB, the bound of what is broadcast).
FILTER_BITS, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 30
#: Candidates that a worker holds at once.
CANDIDATES = 1 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CANDIDATE = "h long, c long, edit int, at int, letter string"
DELETED, REPLACED, INSERTED = 0, 1, 2

#: Odd base of the polynomial hash and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _values(points: np.ndarray) -> np.ndarray:
    """The 64-bit value of each code point in the polynomial."""
    return _mixed(points.astype(np.uint64) * np.uint64(BASE) + np.uint64(1))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _points(word: str) -> np.ndarray:
    return np.frombuffer(word.encode("utf-32-le", "surrogatepass"), "<u4")


def word_hash(word: str) -> int:
    """The hash of a word: the sum of its code points' values by powers of the base, modulo 2^64; as a signed number."""
    p = _points(word)
    return int((_values(p) * _powers(len(p))).sum(dtype=np.uint64).view(np.int64)) if len(p) else 0


def neighbourhood(points: np.ndarray, alphabet: np.ndarray, lo: int = 0, hi: int | None = None) -> tuple[np.ndarray, ...]:
    """(row, hash, edit, at, letter) of the distinct deletions, replacements and insertions of words of one length.

    ``points`` is rows x length. Of edits that give the same string one is taken: letters are deleted at the first of a run, and
    inserted before no equal letter's copy. ``lo`` and ``hi`` bound the places of the edits (the last one is behind the word).
    """
    m, n = points.shape
    hi = n + 1 if hi is None else min(hi, n + 1)
    value, power = _values(points), _powers(n + 1)
    terms = value * power[:n]
    before = np.concatenate((np.zeros((m, 1), np.uint64), np.cumsum(terms, axis=1, dtype=np.uint64)), axis=1)
    whole = before[:, -1:]
    out = []
    letters, a = _values(alphabet), alphabet[None, None, :]
    last = min(hi, n)
    if lo < last:
        here = points[:, lo:last]
        earlier = np.full((m, last - lo), -1, np.int64)
        skip = 1 if lo == 0 else 0
        earlier[:, skip:] = points[:, lo + skip - 1 : last - 1]
        gone = before[:, lo:last] + (whole - before[:, lo + 1 : last + 1]) * np.uint64(INVERSE)
        row, at = np.nonzero(here != earlier)
        out.append((row, gone[row, at], np.full(len(row), DELETED), at + lo, np.zeros(len(row), np.int64)))
        changed = (whole + before[:, lo:last] - before[:, lo + 1 : last + 1])[:, :, None] + letters[None, None, :] * power[lo:last][None, :, None]
        row, at, k = np.nonzero(here[:, :, None] != a)
        out.append((row, changed[row, at, k], np.full(len(row), REPLACED), at + lo, alphabet[k]))
    earlier = np.full((m, hi - lo), -1, np.int64)
    skip = 1 if lo == 0 else 0
    earlier[:, skip:] = points[:, lo + skip - 1 : hi - 1]
    more = (before[:, lo:hi] + (whole - before[:, lo:hi]) * np.uint64(BASE))[:, :, None] + letters[None, None, :] * power[lo:hi][None, :, None]
    row, at, k = np.nonzero(earlier[:, :, None] != a)
    out.append((row, more[row, at, k], np.full(len(row), INSERTED), at + lo, alphabet[k]))
    return tuple(map(np.concatenate, zip(*out)))


def edited(word: Column, edit: Column, at: Column, letter: Column) -> Column:
    """The string of a candidate."""
    tail = F.substring(word, at + F.when(edit == INSERTED, 1).otherwise(2), F.length(word))
    return F.concat(F.substring(word, F.lit(1), at), F.when(edit == DELETED, "").otherwise(letter), tail)


def _slots(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    x = _mixed(h)
    mask = np.uint64(bits - 1)
    return (x & mask).astype(np.int64), ((x >> np.uint64(32)) & mask).astype(np.int64)


def _hashed(words: DataFrame) -> DataFrame:
    """words with their hash ``h``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = np.fromiter((word_hash(w) for w in b.column(0).to_pylist()), np.int64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(h)], names=[*b.schema.names, "h"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, h long")


def _filter(vocabulary: DataFrame, words: int) -> np.ndarray:
    """A Bloom filter of the words' hashes with two bits a word, as bytes; its size is bounded, whatever the number of words."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (FILTER_BITS * max(words, 1) - 1).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.concatenate(_slots(b.column(0).to_numpy().view(np.uint64), bits))
            cell, one = at >> 6, np.uint64(1) << (at & 63).astype(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(one.view(np.int64))], names=["cell", "bit"])

    cells = vocabulary.select("h").mapInArrow(run, "cell long, bit long").groupBy("cell").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(bits >> 6, np.int64)
    out[cells.column(0).to_numpy()] = cells.column(1).to_numpy()
    return out.view(np.uint8)


def _candidates(vocabulary: DataFrame, alphabet: list[int], bloom) -> DataFrame:
    """CANDIDATE rows: of each word's neighbourhood what the filter doesn't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = bloom.value
        letters, bits = np.array(sorted(alphabet), np.int64), len(seen) * 8
        names = pa.array([chr(x) for x in letters.tolist()], pa.string())
        has = lambda at: (seen[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        for b in batches:
            words, own = b.column(0).to_pylist(), b.column(1).to_numpy()
            by_length: dict[int, list[int]] = {}
            for i, w in enumerate(words):
                by_length.setdefault(len(w), []).append(i)
            for n, rows in by_length.items():
                wide = max(1, CANDIDATES // (len(letters) + 1))  # rows and places at once
                many, places = max(1, wide // (n + 1)), min(n + 1, wide)
                for k in range(0, len(rows), many):
                    some = np.array(rows[k : k + many])
                    points = np.stack([_points(words[i]) for i in some.tolist()]).astype(np.int64)
                    for lo in range(0, n + 1, places):
                        row, h, edit, at, letter = neighbourhood(points, letters, lo, lo + places)
                        one, two = _slots(h, bits)
                        left = np.flatnonzero(has(one))
                        left = left[has(two[left])]
                        if len(left):
                            cols = (own[some[row[left]]], h[left].view(np.int64), edit[left].astype(np.int32), at[left].astype(np.int32))
                            letter = names.take(pa.array(np.searchsorted(letters, letter[left]).clip(0, len(letters) - 1)))
                            yield pa.RecordBatch.from_arrays([*map(pa.array, cols), letter], names=["h", "c", "edit", "at", "letter"])

    return vocabulary.select("word", "h").mapInArrow(run, CANDIDATE)


def near_words(counts: DataFrame) -> DataFrame:
    """(word, near, n, near_n): every ordered pair of words of counts (word, n) that differ by exactly one inserted, deleted or replaced code point.

    Words are distinct; null and empty ones have no row. Each word gives out its whole neighbourhood over the vocabulary's
    alphabet. A Bloom filter of bounded size, broadcast, rules out most candidates; the others meet the vocabulary in a join on
    64-bit hashes, and the candidate's string, made from word and edit, must equal the word found. No distance is worked out. Work and rows
    out grow with words times length, not with pairs; a very long word's neighbourhood is made a part at a time and carried as hashes.
    """
    vocabulary = written_table(_hashed(counts.where("word <> ''")))
    sizes = vocabulary.agg(F.count("*")).first()[0]
    # At most the code points of the alphabet that words are made of.
    alphabet = [r[0] for r in vocabulary.select(F.explode(F.array_distinct(F.split("word", ""))).alias("x")).where("x <> ''").distinct().collect()]
    bloom = counts.sparkSession.sparkContext.broadcast(_filter(vocabulary, sizes))
    found = _candidates(vocabulary, [ord(x) for x in alphabet], bloom)
    target = vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n"), F.col("h").alias("c"))
    found = found.join(target, "c").join(vocabulary, "h")
    return found.where(edited(F.col("word"), F.col("edit"), F.col("at"), F.col("letter")) == F.col("near")).select("word", "near", "n", "near_n")


def with_roots(forms: DataFrame) -> DataFrame:
    """forms (word, form) with ``root``, the last of the forms that follow from a word: the word itself if it has none.

    Forms must not go round. Paths are halved in each round, so rounds grow with the logarithm of the longest one.
    """
    paths = cut_lineage(forms.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        step = paths.select(F.col("word").alias("w"), F.col("root").alias("next"))
        found = cut_lineage(paths.join(step, F.col("root") == F.col("w"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        paths = found.select("word", "root")
        if found.where("moved").isEmpty():
            break
    return forms.join(paths.withColumnRenamed("word", "w"), F.col("word") == F.col("w"), "left").withColumn("root", F.coalesce("root", "word")).drop("w")


def spelling_variants(counts: DataFrame, ratio: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of counts (word string, n long).

    form is the near word of largest n (ties: the smallest in code-point order) if that n is at least ``ratio`` (2 at least) times the word's,
    else null; form_n its n. n_near counts near words. root is where the forms that follow end. Null words have no row, repeated
    ones are summed, an empty table gives no rows; other columns aren't read.
    """
    words = written_table(counts.where("word <> ''").groupBy("word").agg(F.sum("n").cast("long").alias("n")))
    near = near_words(words)
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("near"))).alias("best"))
    best = best.withColumnRenamed("word", "w")
    all_words = words.join(best, F.col("word") == F.col("w"), "left")
    form_n = -F.col("best.n")
    good = form_n >= F.lit(ratio) * F.col("n")
    found = all_words.select("word", F.when(good, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(good, form_n).alias("form_n"))
    return with_roots(cut_lineage(found)).select("word", "form", "root", "n", "n_near", "form_n")


def lower_ascii(text: Column) -> Column:
    """text with A-Z, and nothing else, lower-cased; only texts that have some are rewritten."""
    return F.when(text.rlike("[A-Z]"), F.translate(text, UPPER, LOWER)).otherwise(text)


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pattern: str = r"[A-Za-zÀ-ÿ]+", drop_one_in: int | None = None, least_length: int = 5, least_count: int = 3) -> DataFrame:
    """(word, n) over whole texts: maximal runs of the pattern, A-Z lower-cased, of so many code points and occurrences at least.

    With ``drop_one_in`` the run loses a code point where that number divides the CRC-32 of ``id:run``, that at CRC-32 modulo length (a null id
    counts as an empty one). Null and empty texts have no words; counts are summed before the exchange.
    """
    runs = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col(f"`{text_col}`"), F.lit(pattern), 0)).alias("run"))
    word = lower_ascii(F.col("run"))
    if drop_one_in:
        runs = runs.select("id", word.alias("run"))
        h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
        at = (h % F.length("run")).cast("int")
        word = F.when(h % drop_one_in == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run"))
    return runs.select(word.alias("word")).where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(word_counts(read_table(spark, sf_dir, "documents"), drop_one_in=97))
