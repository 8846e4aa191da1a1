"""Periodic runs of words: a harmonic grid of longest common extensions over suffix arrays."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from orbitframe.llm.batches import bound_batches, text_parts
from orbitframe.session import read_table

#: Words of a block of the range minimum, and queries worked out at once.
BLOCK, QUERIES = 16, 1 << 19

RUNS = "id long, n_words long, runs array<struct<start:long,length:long,period:long>>, text string"


def suffix_array(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, rank, lcp) of the suffixes of x; lcp[i] is that of the suffixes at order[i - 1] and order[i].

    Prefixes are doubled, and only suffixes that share theirs with others are sorted again; a rank is the place of the first suffix of
    its group. The ranks of each doubling give the common prefixes of neighbours from the longest power down.
    """
    n = len(x)
    order = np.argsort(x, kind="stable")
    key, at, width = x[order], np.arange(n), 1
    rank, levels = np.empty(n, np.int32), []
    while True:
        new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(new, append=len(key))
        rank[order[at]] = np.repeat(at[new], size)
        levels.append(rank.copy())
        at = at[np.repeat(size > 1, size)]
        if not len(at):
            break
        some = order[at].astype(np.int64)
        after = np.zeros(len(some), np.int64)
        fits = np.flatnonzero(some + width < n)
        after[fits] = rank[some[fits] + width] + 1
        key = rank[some].astype(np.int64) * (n + 1) + after
        by = np.argsort(key)
        order[at], key = some[by], key[by]
        width *= 2
    lcp = np.zeros(n, np.int32)
    a, b = order[:-1].astype(np.int64), order[1:].astype(np.int64)
    for k in range(len(levels) - 1, -1, -1):
        level = levels.pop()
        fits = np.flatnonzero((a + (1 << k) <= n) & (b + (1 << k) <= n))
        same = fits[level[a[fits]] == level[b[fits]]]
        lcp[1 + same] += 1 << k
        a[same] += 1 << k
        b[same] += 1 << k
    return order, rank, lcp


class RangeMinimum:
    """Minima of ranges of an array: minima to both ends of a block inside blocks, a sparse table across them."""

    def __init__(self, x: np.ndarray):
        self.n = len(x)
        top = np.iinfo(x.dtype).max
        blocks = np.full((-(-self.n // BLOCK), BLOCK), top, x.dtype)
        blocks.reshape(-1)[: self.n] = x
        self.x = blocks.reshape(-1)
        self.left = np.minimum.accumulate(blocks, axis=1).reshape(-1)
        self.right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        self.table = [blocks.min(axis=1)]
        while 2 << (len(self.table) - 1) <= len(blocks):
            half, last = 1 << (len(self.table) - 1), self.table[-1]
            self.table.append(np.minimum(last[:-half], last[half:]))

    def query(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The minimum of x[lo .. hi], both included, lo <= hi."""
        a, b = lo // BLOCK, hi // BLOCK
        out = np.minimum(self.right[lo], self.left[hi])
        between = np.flatnonzero(b - a > 1)
        if len(between):
            first, count = a[between] + 1, b[between] - a[between] - 1
            level = np.frexp(count.astype(np.float64))[1] - 1
            least = np.empty(len(between), self.x.dtype)
            for k in np.unique(level):
                at = np.flatnonzero(level == k)
                t, f = self.table[k], first[at]
                least[at] = np.minimum(t[f], t[f + count[at] - (1 << int(k))])
            out[between] = np.minimum(out[between], least)
        inside = np.flatnonzero(a == b)
        if len(inside):
            f, h = lo[inside], hi[inside]
            least = self.x[f]
            for step in range(1, BLOCK):
                least = np.minimum(least, self.x[np.minimum(f + step, h)])
            out[inside] = least
        return out


class Extensions:
    """Longest common extensions of an array: forward over its suffixes, backward over those of the reversed array."""

    def __init__(self, x: np.ndarray):
        self.n = len(x)
        _, self.rank, lcp = suffix_array(x)
        self.minimum = RangeMinimum(lcp)
        _, self.back_rank, lcp = suffix_array(x[::-1])
        self.back_minimum = RangeMinimum(lcp)

    @staticmethod
    def _lce(rank: np.ndarray, minimum: RangeMinimum, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        r, s = rank[a], rank[b]
        return minimum.query(np.minimum(r, s) + 1, np.maximum(r, s)).astype(np.int64)

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Equal entries from a and b (different ones) on."""
        return self._lce(self.rank, self.minimum, a, b)

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Equal entries before a and b, both at least 1."""
        return self._lce(self.back_rank, self.back_minimum, self.n - a, self.n - b)


def _grid(starts: np.ndarray, sizes: np.ndarray, most: int, times: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document, period, place) of every j p with (j + 1) p inside the document, for periods to size // times; about ``most`` at once."""
    for low in range(len(sizes)):
        top = int(sizes[low]) // times
        at = 1
        while at <= top:
            # Periods from here on whose places together are about ``most``.
            some = np.arange(at, min(top, at + max(1, most // 8)) + 1)
            places = (sizes[low] - 1) // some
            upto = max(1, int(np.searchsorted(np.cumsum(places), most, side="right")))
            some, places = some[:upto], places[:upto]
            at += len(some)
            period = np.repeat(some, places)
            j = np.arange(len(period)) - np.repeat(np.cumsum(places) - places, places)
            yield np.full(len(period), low), period, starts[low] + j * period


def _gathered(parts: Iterator[tuple], most: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Parts joined to about ``most`` rows, so that short documents share the work of a query."""
    held, size = [], 0
    for p in parts:
        held.append(p)
        size += len(p[0])
        if size >= most:
            yield tuple(map(np.concatenate, zip(*held)))
            held, size = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held)))


def find_runs(docs: list[np.ndarray], least: int = 6, times: int = 4) -> list[np.ndarray]:
    """For each array of word numbers its runs (start, length, period), by start, then period.

    A run is a stretch with smallest period q, of ``times`` q entries and ``least`` at least, that no neighbour extends. The documents
    are parted by numbers of their own, so no extension leaves one, and share one suffix array.
    """
    sizes = np.array([len(d) for d in docs], np.int64)
    starts = np.cumsum(sizes + 1) - sizes
    top = max((int(d.max()) for d in docs if len(d)), default=0) + 1
    x = np.arange(top, top + int(sizes.sum()) + len(docs) + 1, dtype=np.int64)  # what isn't overwritten parts documents
    for s, d in zip(starts.tolist(), docs):
        x[s : s + len(d)] = d
    found = [np.zeros((0, 4), np.int64)]
    if (sizes >= max(least, times)).any():
        ext = Extensions(x)
        some = np.flatnonzero(sizes >= max(least, times))
        for doc, period, at in _gathered(_grid(starts[some], sizes[some], QUERIES, times), QUERIES):
            # Where the two entries differ nothing extends forward; a run of 2 p or more has a place where they don't.
            like = np.flatnonzero(x[at] == x[at + period])
            doc, period, at = doc[like], period[like], at[like]
            back = ext.backward(at, at + period)
            length = back + ext.forward(at, at + period) + period
            hit = np.flatnonzero(length >= np.maximum(least, times * period))
            if len(hit):
                doc = some[doc[hit]]
                found.append(np.unique(np.stack((doc, at[hit] - back[hit] - starts[doc], length[hit], period[hit]), axis=1), axis=0))
    rows = np.concatenate(found)
    # Of equal stretches the least period is the smallest one; multiples of it have the same ends.
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    if len(rows):
        rows = rows[np.concatenate(([True], (rows[1:, :3] != rows[:-1, :3]).any(axis=1)))]
        rows = rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]
    cuts = np.searchsorted(rows[:, 0], np.arange(len(docs) + 1))
    return [rows[a:b, 1:] for a, b in zip(cuts[:-1], cuts[1:])]


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words, joined by a space, without those that a run has after its first period."""
    if not len(runs):
        return b" ".join(words)
    deep = np.zeros(len(words) + 1, np.int64)
    np.add.at(deep, runs[:, 0] + runs[:, 2], 1)
    np.add.at(deep, runs[:, 0] + runs[:, 1], -1)
    return b" ".join(words[i] for i in np.flatnonzero(np.cumsum(deep[:-1]) == 0).tolist())


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, times: int = 4) -> DataFrame:
    """(id, n_words, runs, text) of every row: the periodic runs of words, and the text with each run cut to its first period.

    Words are runs of other than ASCII white space, numbered from 0, and differ unless equal byte by byte. Runs (start, length, period)
    come by start, then period, overlapping ones too. Null and empty texts, and those of white space, have no words, no runs
    and an empty text; a null id stays null, repeated rows stay, an empty table gives no rows, other columns, whatever their names,
    aren't read. Texts are read whole: a task holds the arrays of a quarter of a megabyte of text, or of one longer text
    (about 80 bytes a word, and 4 for each doubling of its longest repeat).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, part in text_parts(b, 1):
                words = [(t or b"").split() for t in part]
                number: dict[bytes, int] = defaultdict(count().__next__)
                codes = [np.fromiter(map(number.__getitem__, ws), np.int64, len(ws)) for ws in words]
                runs = find_runs(codes, least, times)
                cuts = pa.array(np.cumsum([0, *map(len, runs)]), pa.int32())
                flat = np.concatenate(runs)
                spans = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], names=["start", "length", "period"])
                texts = pa.array([collapsed(ws, r).decode() for ws, r in zip(words, runs)], pa.string())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(part)), pa.array(list(map(len, words)), pa.int64()), pa.ListArray.from_arrays(cuts, spans), texts], names=["id", "n_words", "runs", "text"])

    bound_batches(docs.sparkSession)
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("t"))
    return src.mapInArrow(run, RUNS)


def with_planted_runs(doc_id: Column, text: Column) -> Column:
    """The text, in one of ten by the id's CRC-32 with a tail that repeats some of its words, joined by spaces."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def planted(words: Column) -> Column:
        n = F.size(words)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        picked = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))
        return F.array_join(F.transform(picked, lambda i: F.get(words, i)), " ")

    # As an element of an array the words are worked out once.
    words = F.array(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), 0))
    return F.when((h % 10 == 0) & text.rlike(r"[^\x20\x09-\x0D]"), F.get(F.transform(words, planted), F.lit(0))).otherwise(text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = periodic_runs(docs.select("doc_id", with_planted_runs(F.col("doc_id"), F.col("text")).alias("text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period)), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return found.withColumn("best", best).select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.floor(F.col("best.length") * 1000 / -F.col("best.period")).alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"), "n_words",
    )
