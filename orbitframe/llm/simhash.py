"""SimHash near-duplicates found by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from orbitframe.llm.batches import bound_batches, text_parts
from orbitframe.llm.blocks import join_spread
from orbitframe.llm.components import connected_components
from orbitframe.session import cut_lineage, read_table, written_table

#: Segments of the fingerprint: shift, width, and radius of the ball to look up. If two fingerprints differ in at most 4 bits,
#: one of the first two segments differs in at most 1 or the last in none; or the first of two halves in at most 2 or the other in 1.
#: Halves take some 300 look-ups a fingerprint in place of 23, and meet 80 times fewer fingerprints by chance.
THIRDS, HALVES = ((0, 21, 1), (21, 21, 1), (42, 22, 0)), ((0, 32, 2), (32, 32, 1))
#: Distinct fingerprints from which halves are the less work. Both find every pair.
HALVES_FROM = 1 << 25


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """The 64-bit SimHash of a text as an unsigned integer; no words (or null) give 0.

    Words are runs of other than ASCII white space, after lower-casing A-Z; shingles are ``width``
    words, repeats included; a text of fewer words is one shingle. Bit i is 1 if more than half of
    the shingles' XXH64 have it.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    n = len(words) - width + 1
    if n <= 1:
        return digest(b" ".join(words), seed)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    counts = np.zeros(64, np.int64)
    for lo in range(0, n, 8192):
        hi = min(n, lo + 8192)
        spans = zip(starts[lo:hi].tolist(), ends[lo + width - 1 : hi + width - 1].tolist())
        h = np.fromiter((digest(joined[s:e], seed) for s, e in spans), np.uint64, hi - lo)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (counts * 2 > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(id, fp long) of every row; fp holds the 64 bits of the fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t, width) for _, part in text_parts(b, 1) for t in part), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    bound_batches(docs.sparkSession)
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("t"))
    return src.mapInArrow(run, "id long, fp long")


def _value(shift: int, width: int) -> Column:
    return F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1))


def _distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _table(keys: DataFrame, segments, *more: str) -> DataFrame:
    """A row for each segment of a fingerprint; the segment's number is part of the key."""
    key = [_value(s, w).bitwiseOR(F.lit(i << 32)) for i, (s, w, _) in enumerate(segments)]
    return keys.select("fp", *more, F.explode(F.array(*key)).alias("key"))


def _ball(v: Column, width: int, radius: int) -> Column:
    """The values within ``radius`` (2 at most) bits of v that are looked up from this side, v among them.

    Of two values that differ, only the one that has the lowest differing bit set flips it, so each pair is
    looked up from one side.
    """
    bits = F.array(*[F.lit(1 << b).cast("long") for b in range(width)])
    own = F.filter(bits, lambda b: v.bitwiseAND(b) != 0)
    one = F.transform(own, lambda b: v.bitwiseXOR(b))
    two = F.flatten(F.transform(own, lambda b: F.transform(F.filter(bits, lambda c: c > b), lambda c: v.bitwiseXOR(b).bitwiseXOR(c))))
    return F.concat(F.array(v), *[one, two][:radius])


def _probes(keys: DataFrame, segments, *more: str) -> DataFrame:
    """The Hamming balls to look up in the tables of segments."""
    balls = []
    for i, (shift, width, radius) in enumerate(segments):
        v = _value(shift, width)
        balls.append(_keyed(_ball(v, width, radius), v, i))
    return keys.select("fp", *more, F.inline(F.concat(*balls))).withColumnsRenamed({"fp": "probe", "key": "pkey"})


def _keyed(ball: Column, v: Column, i: int) -> Column:
    return F.transform(ball, lambda u: F.struct(u.bitwiseOR(F.lit(i << 32)).alias("key"), (u == v).alias("same")))


def _members(keys: DataFrame, edges: DataFrame) -> DataFrame:
    """(fp, comp): the component of each key under edges (a, b)."""
    found = connected_components(edges).withColumnRenamed("id", "fp")
    return keys.join(found, "fp", "left").select("fp", F.coalesce("component", "fp").alias("comp"))


def linked_fingerprints(keys: DataFrame, distance: int = 4, segments=None) -> DataFrame:
    """(fp, comp) of distinct fingerprints; two within ``distance`` (4 at most) bits share comp.

    First every bucket of equal segments ties its members to its least one where the complete
    distance allows. Then the Hamming balls are fetched from the tables and verified; pairs that
    are together already are not given out again, so a large group of near copies makes about as
    many rows as it has members, not the square of that. ``segments``: THIRDS or HALVES, by their number if not given.
    """
    if not 0 <= distance <= 4:
        raise ValueError("the segments' balls are for at most 4 bits")
    segments = segments or (HALVES if keys.count() >= HALVES_FROM else THIRDS)
    t = _table(keys, segments)
    hubs = t.groupBy("key").agg(F.min("fp").alias("hub"))
    stars = t.join(hubs, "key").where((F.col("fp") != F.col("hub")) & (_distance("fp", "hub") <= distance))
    held = cut_lineage(_members(keys, stars.select(F.col("fp").alias("a"), F.col("hub").alias("b"))))
    probes = _probes(held, segments, "comp").withColumnRenamed("comp", "pcomp")
    pairs = _table(held, segments, "comp").join(
        probes,
        (F.col("key") == F.col("pkey")) & (_distance("fp", "probe") <= distance) & (F.col("comp") != F.col("pcomp")) & (~F.col("same") | (F.col("fp") < F.col("probe"))),
    )
    more = connected_components(pairs.select(F.col("comp").alias("a"), F.col("pcomp").alias("b")))
    more = more.select(F.col("id").alias("comp"), "component")
    return held.join(more, "comp", "left").select("fp", F.coalesce("component", "comp").alias("comp"))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, distance: int = 4) -> DataFrame:
    """(id, fp, component): a row for each row of docs; component is the smallest id reachable.

    Fingerprints of at most ``distance`` differing bits link. Null and empty texts have fingerprint
    zero and link like others; a null id gets a row and never names a component unless all ids of
    its group are null. Repeated rows stay. An empty table gives no rows. Equal fingerprints are
    one key in the search, however many rows have them, and rows of a very common one are spread in the join that names them.
    Other columns, whatever their names, aren't read; very long texts are read whole.
    """
    fps = cut_lineage(fingerprints(docs, id_col, text_col, width))
    classes = fps.groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    linked = linked_fingerprints(classes.select("fp"), distance)
    of = classes.join(linked, "fp")
    least = of.groupBy("comp").agg(F.min("rep").alias("component"))
    return join_spread(fps, of.join(least, "comp").select("fp", "n", "component"), "fp", "n", "id").select("id", "fp", "component")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, distance: int = 4) -> DataFrame:
    """The documents, one of each group of near-duplicates: that of the smallest id.

    Rows with a null id are kept; of rows with the same id all stay or go together. For tables with
    such rows see one_of_each_group. Null and empty texts are a group; long texts are read whole. Columns may have any
    names; an empty table gives no rows.
    """
    found = simhash_groups(docs, id_col, text_col, width, distance)
    out = found.where(F.col("id") != F.col("component")).select(F.col("id").alias("gone")).distinct()
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    rows = rows.join(out, F.col(f"row.`{id_col}`").cast("long") == F.col("gone"), "left_anti")
    return rows.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, distance: int = 4) -> DataFrame:
    """The documents, exactly one row of each group of near-duplicates, whatever the ids.

    It is the first by id (null last), text hash and a written row key; rows that share an id,
    or have none, are told apart by that key. Null and empty texts are a group; repeated rows go but
    one. All columns stay, whatever their names; an empty table gives no rows.
    """
    keyed = written_table(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.monotonically_increasing_id().alias("key")))
    names = keyed.select("key", F.col(f"row.`{id_col}`").cast("long").alias("id"), F.col(f"row.`{text_col}`").alias("text"))
    fps = cut_lineage(fingerprints(names, "key", "text", width))
    linked = linked_fingerprints(fps.select("fp").distinct(), distance)
    order = F.struct(F.col("id").isNull().alias("late"), "id", "th", "key")
    first = fps.select(F.col("id").alias("key"), "fp").join(names.select("key", "id", F.xxhash64("text").alias("th")), "key").groupBy("fp").agg(F.min(order).alias("first"))
    first = first.join(linked, "fp").groupBy("comp").agg(F.min("first").alias("first"))
    return keyed.join(first.select(F.col("first.key").alias("key")), "key", "left_semi").select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = simhash_groups(read_table(spark, sf_dir, "documents"))
    return g.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
