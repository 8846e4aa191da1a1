"""Winnowing fingerprints of documents, with DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from orbitframe.session import read_table

#: Code points of a gram; grams of a window, as steps whose product it is.
GRAM, WINDOW = 8, (4, 4)
#: A gram packed in a long is its hash, of 31 bits, times 2 ** 32 minus its position: of equal hashes the rightmost is least.
SHIFT = 32
MASK = ((1 << 63) - 1) >> SHIFT << SHIFT
#: Documents of a part of the id order, about, and parts at most.
PART_ROWS, MAX_PARTS = 5_000, 20_000


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value worked out once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _grams(text: Column, k: int) -> Column:
    """Packed hash and position of every run of k code points; a shorter text is one gram, an empty one has none.

    One pass of a pattern that looks ahead gives the gram at each position, and its XXH64 is the hash.
    """
    pack = lambda gram, i: F.xxhash64(gram).bitwiseAND(F.lit(MASK)) - i
    every = F.transform(F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{k}}}))."), F.lit(1)), pack)
    size = F.char_length(text)
    return F.when(size >= k, every).when(size > 0, F.array(pack(text, F.lit(0)))).otherwise(F.expr("cast(array() as array<bigint>)"))


def _select(grams: Column, w: tuple[int, ...]) -> Column:
    """The least gram of every window, once each; packing makes the rightmost of equal hashes the least.

    A window's minimum is that of n shorter windows side by side, so a window of 16 takes 3 + 3 looks, not 15.
    """

    def step(n: int, stride: int, cut: int) -> Callable[[Column], Column]:
        def least(x: Column) -> Column:
            starts = F.slice(x, 1, F.greatest(F.size(x) - cut, F.lit(1)))
            return F.transform(starts, lambda v, i: F.least(v, *(F.get(x, i + m * stride) for m in range(1, n))))

        return lambda x: F.when(F.size(x) > 0, least(x)).otherwise(x)

    stride = 1
    for at, n in enumerate(w):
        grams = _let(grams, step(n, stride, math.prod(w) - 1 if at == len(w) - 1 else 0))
        stride *= n
    return F.array_distinct(grams)


def _hash(p: Column) -> Column:
    return F.shiftright(p + F.lit((1 << SHIFT) - 1), SHIFT)


def winnow(df: DataFrame, text: str, out: str, k: int = GRAM, w: tuple[int, ...] = WINDOW) -> DataFrame:
    """df with the column ``out``: array of structs (position, hash) of the text's winnowing.

    Every run of k + 16 - 1 (23) equal code points in two texts, with or without spaces, selects a common gram. Positions
    count code points from 0 and rise; hashes have 31 bits. Null texts are empty ones, whose array is
    empty; a text of fewer than k code points is one gram of its own. Very long texts are read whole.
    Rows are independent; repeated ones and null ids stay; other columns are kept, one named ``out`` is replaced.
    """
    one = lambda p: F.struct((F.shiftleft(_hash(p), SHIFT) - p).cast("int").alias("position"), _hash(p).cast("int").alias("hash"))
    return df.withColumn(out, F.transform(packed_selection(F.col(text), k, w), one))


def packed_selection(text: Column, k: int = GRAM, w: tuple[int, ...] = WINDOW) -> Column:
    return _let(F.coalesce(text, F.lit("")), lambda t: _select(_grams(t, k), w))


def _hashes(packed: str) -> Column:
    return F.array_distinct(F.transform(packed, lambda p: _hash(p).cast("int")))


def _digest(packed: str) -> Column:
    """SHA-256 of the selected grams, hash and position, in order."""
    return F.sha2(F.array_join(F.col(packed).cast("array<string>"), ","), 256)


def likeness(a: str, b: str) -> Column:
    """Jaccard likeness of two hash arrays; two empty ones are alike."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def with_next(docs: DataFrame, id_col: str, order: str, *carried: str) -> DataFrame:
    """docs with next_<column> of the following row in descending id order, after the last the first.

    Ids are cut into parts at quantiles. An id that fills parts of its own (null, or one repeated very often) is cut further by
    ``order``, a long that is spread evenly. The first row of each part is also sent to the end of
    the part before it, so each row meets its follower inside one part, and only parts' first rows' keys
    (some MAX_PARTS) are gathered. Rows of equal id are in order of ``order``; null ids are last.
    """
    docs = docs.withColumns({"_o": F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))), "_x": F.coalesce(F.col(id_col).cast("double"), F.lit(-float(1 << 63)))})
    n = docs.count()
    parts = max(1, min(MAX_PARTS, n // PART_ROWS))
    found = sorted(docs.approxQuantile("_x", [i / parts for i in range(1, parts)], 0.2 / parts)) if parts > 1 else []
    often = {a for a, b in zip(found, found[1:]) if a == b}
    splits = [-math.inf, *sorted({*found, *(math.nextafter(x, math.inf) for x in often)}), math.inf]
    if len(splits) > 2:
        docs = Bucketizer(splits=splits, inputCol="_x", outputCol="_part").transform(docs)
    else:
        docs = docs.withColumn("_part", F.lit(0.0))
    spark = docs.sparkSession
    sizes = docs.groupBy("_part").agg(F.count("*").alias("n"), F.min("_o").alias("lo"), F.max("_o").alias("hi")).collect()
    slices = spark.createDataFrame([(r["_part"], max(1, r.n // PART_ROWS) if r.lo == r.hi else 1) for r in sizes] or [(0.0, 1)], "_p double, _slices long")
    share = F.floor((F.shiftright(order, 32) + F.lit(1 << 31)) * F.col("_slices") / F.lit(1 << 32))
    docs = docs.join(F.broadcast(slices), F.col("_part") == F.col("_p")).withColumn("_slice", share).drop("_p", "_slices", "_x")
    first = F.min(F.struct(F.bitwise_not("_o").alias("not_o"), F.col(order).alias("order"))).alias("first")
    tops = sorted(docs.groupBy("_part", "_slice").agg(first).collect(), key=lambda r: (-r["_part"], r["_slice"]))
    sent = [(~r.first.not_o, r.first.order, before["_part"], before["_slice"]) for before, r in zip(tops[-1:] + tops, tops)]  # to the end of the part before
    sent = F.broadcast(spark.createDataFrame(sent, "_fo long, _forder long, _to double, _to_slice long"))
    both = docs.join(sent, (F.col("_o") == F.col("_fo")) & (F.col(order) == F.col("_forder")), "left")
    at = lambda part, slice_, ghost: F.struct(F.col(part).alias("_at"), F.col(slice_).alias("_at_slice"), F.lit(ghost).alias("_ghost"))
    here = at("_part", "_slice", False)
    both = both.select("*", F.inline(F.when(F.col("_to").isNull(), F.array(here)).otherwise(F.array(here, at("_to", "_to_slice", True)))))
    by = Window.partitionBy("_at", "_at_slice").orderBy("_ghost", F.col("_o").desc(), order)
    out = both.withColumns({f"next_{c}": F.lead(c).over(by) for c in carried})
    return out.where("not _ghost").drop("_o", "_part", "_slice", "_fo", "_forder", "_to", "_to_slice", "_at", "_at_slice", "_ghost")


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = GRAM, w: tuple[int, ...] = WINDOW) -> DataFrame:
    """Fingerprints of each text and its edited text, and their likenesses.

    The edited text has its last floor(n / 3) code points replaced by the first as many of the next
    document. Columns: id, n_chars, edited, edited_packed, fingerprint, near_edited,
    near_next. A single document follows itself; repeated rows follow each other; null ids come last. Null texts are empty ones;
    very long ones are read whole; other columns, whatever their names, aren't read; an empty table gives no rows.
    """
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    own = src.withColumn("packed", packed_selection(F.col("text"), k, w))
    own = own.select("id", "text", F.xxhash64("text").alias("th"), F.char_length("text").alias("n"), _digest("packed").alias("fingerprint"), _hashes("packed").alias("hashes"))
    both = with_next(own, "id", "th", "text", "hashes")
    m = F.floor(F.col("n") / 3).cast("int")
    both = both.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.col("n") - m), F.substring(F.col("next_text"), F.lit(1), m)))
    both = both.drop("text", "next_text").withColumn("edited_packed", packed_selection(F.col("edited"), k, w))
    both = both.withColumn("edited_hashes", _hashes("edited_packed"))
    return both.select("id", F.col("n").cast("long").alias("n_chars"), "edited", "fingerprint", "edited_packed", likeness("hashes", "edited_hashes").alias("near_edited"), likeness("hashes", "next_hashes").alias("near_next"))


def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edited_likeness(read_table(spark, sf_dir, "documents"))
    return e.select(F.col("id").alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", _digest("edited_packed").alias("edited_fingerprint"), "near_edited", "near_next")
