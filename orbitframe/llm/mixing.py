"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from orbitframe.session import cut_lineage, read_table

#: Hexadecimal digits of the shuffle key that deal a source into slices, and parts of virtual time.
SLICE_DIGITS, TIME_PARTS = 3, 4096
EPOCHS = 3


def word_count(text: Column) -> Column:
    """Runs of other than ASCII white space; null has 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, name_col: str | None) -> DataFrame:
    text = F.col(f"`{text_col}`")
    key = F.md5(F.concat(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")))))
    name = F.col(f"`{name_col}`") if name_col else F.lit(None)
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{source_col}`").cast("string").alias("src"), key.alias("key"), word_count(text).alias("size"), name.cast("long").alias("name"))


def source_targets(sizes: DataFrame, weights: Column | None = None, epochs: int = EPOCHS) -> DataFrame:
    """(src, rank, source_size, target) of every source of ``sizes`` (src, size).

    Sources in order of code points, null last, weigh 1, 2, 3, 1, ... unless ``weights`` (of rank,
    from 1) says otherwise. They share the sum of sizes by weight; a source stops at ``epochs``
    times its size, and what that leaves is shared by weight again until none is above. In closed
    form: with sources sorted by size per weight, the first k stop, for the least k whose
    remaining share per weight no other source passes. There is one row for each source here,
    never one for each document.
    """
    s = sizes.groupBy("src").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("rank", F.row_number().over(Window.orderBy(F.col("src").asc_nulls_last())))
    s = s.withColumn("w", (weights if weights is not None else (F.col("rank") - 1) % 3 + 1).cast("long"))
    by = Window.orderBy(F.col("source_size") / F.col("w"), "rank")
    s = s.withColumns({
        "stop": F.col("source_size") * epochs,
        "before": F.coalesce(F.sum("source_size").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * epochs,
        "left": F.sum("w").over(by.rowsBetween(0, Window.unboundedFollowing)),
        "total": F.sum("source_size").over(Window.partitionBy()),
    })
    level = (F.col("total") - F.col("before")) / F.col("left")
    s = s.withColumn("level", F.when(level * F.col("w") <= F.col("stop"), level))
    s = s.withColumn("level", F.first("level", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    target = F.coalesce(F.least(F.col("level") * F.col("w"), F.col("stop").cast("double")), F.col("stop").cast("double"))
    return s.select("src", "rank", "source_size", target.alias("target"), "total")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Column | None = None, name_col: str | None = None) -> DataFrame:
    """(id, src, size, source_size, target, taken, name) of every row; name is the column ``name_col``, a number of its own for each row, or null.

    A document's size is its number of words (null: 0). Within its source documents are in order of
    the MD5 of their id and text, so that rows which share an id, or have none, are spread too; copy e of a document finishes at (e times the source's size + the sizes
    up to it) / target, and starts when its predecessor finishes. Copies that start before time 1 go
    out in order of finish times, ties by source and key, until the next one would pass the
    sum of all sizes. taken is size times the copies that went out, at most 3. Each source misses its
    target by less than its largest document. Reruns agree. Rows of the same id and text are
    interchangeable. Null and empty texts have size 0, and very long ones count whole; null sources are
    a source. Columns besides the three may have any names and aren't read. An empty table gives no
    rows; if all sizes are 0, nothing is taken and targets are 0.

    A source's running sums go over slices of its keys, so no task holds a whole source; the order of
    finish times goes over parts of time with equal numbers of words. What is summed over all
    slices or parts has at most 4,096 rows a source or in all.
    """
    base = cut_lineage(_sized(docs, id_col, text_col, source_col, name_col).withColumn("slice", F.substring("key", 1, SLICE_DIGITS)))
    targets = source_targets(base, weights)
    slices = base.groupBy("src", "slice").agg(F.sum("size").alias("s"))
    before = Window.partitionBy("src").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("offset", F.coalesce(F.sum("s").over(before), F.lit(0)))
    slices = slices.join(targets.withColumnRenamed("src", "tsrc"), F.col("src").eqNullSafe(F.col("tsrc")))
    slices = slices.select(F.col("src").alias("ssrc"), F.col("slice").alias("sslice"), "offset", "rank", "source_size", "target", "total")
    inside = Window.partitionBy("src", "slice").orderBy("key", "size", "id")
    rows = base.withColumns({"n": F.row_number().over(inside), "upto": F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))})
    rows = rows.join(slices, F.col("src").eqNullSafe(F.col("ssrc")) & (F.col("slice") == F.col("sslice")))
    rows = rows.withColumn("upto", F.col("upto") + F.col("offset")).drop("ssrc", "sslice", "offset")
    time = lambda words: words / F.col("target")
    queued = rows.where("target > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(EPOCHS - 1))))
    done = F.col("epoch") * F.col("source_size") + F.col("upto")
    queued = queued.where(time(done - F.col("size")) < 1).withColumn("finish", time(done))
    queued = cut_lineage(queued.withColumn("part", F.floor(F.least("finish", F.lit(1.0)) * TIME_PARTS)).select("src", "slice", "n", "rank", "key", "size", "total", "epoch", "finish", "part"))
    parts = queued.groupBy("part").agg(F.sum("size").alias("s"))
    parts = parts.withColumn("gone", F.coalesce(F.sum("s").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    order = Window.partitionBy("part").orderBy("finish", "rank", "key", "n", "epoch").rowsBetween(Window.unboundedPreceding, 0)
    queued = queued.withColumn("run", F.sum("size").over(order)).join(parts.select("part", "gone"), "part")
    went = queued.where(F.col("gone") + F.col("run") <= F.col("total"))
    went = went.select("src", "slice", "n", F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("size"), F.lit(None).cast("long").alias("source_size"), F.lit(None).cast("double").alias("target"), F.col("size").alias("taken"), F.lit(None).cast("long").alias("name"))
    every = rows.select("src", "slice", "n", "id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"), "name").union(went)
    out = every.groupBy("src", "slice", "n").agg(F.max("id").alias("id"), F.max("size").alias("size"), F.max("source_size").alias("source_size"), F.max("target").alias("target"), F.sum("taken").alias("taken"), F.max("name").alias("name"))
    return out.select("id", "src", "size", "source_size", "target", "taken", "name")


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mix(read_table(spark, sf_dir, "documents"))
    return m.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


OP6_SQL = r"""
with base as (
  select doc_id, source, md5(coalesce(cast(doc_id as varchar), '') || ':' || md5(coalesce(text, ''))) as key,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size
  from documents
),
s0 as (select source, sum(size)::bigint as source_size from base group by source),
s1 as (select *, row_number() over (order by source asc nulls last) as rank from s0),
s2 as (select *, (rank - 1) % 3 + 1 as w from s1),
s3 as (
  select *, source_size * 3 as stop, sum(source_size) over () as total,
    coalesce(sum(source_size) over (order by source_size::double / w, rank rows between unbounded preceding and 1 preceding), 0) * 3 as before,
    sum(w) over (order by source_size::double / w, rank rows between current row and unbounded following) as w_left,
    row_number() over (order by source_size::double / w, rank) as k
  from s2
),
s4 as (select *, (total - before)::double / w_left::double as level from s3),
lv as (select level from s4 where level * w <= stop order by k limit 1),
targets as (
  select source, rank, source_size, total::bigint as total, coalesce(least((select level from lv) * w, stop::double), stop::double) as target from s4
),
rows_ as (
  select b.doc_id, b.key, b.size, t.rank, t.source_size, t.target, t.total,
    (sum(b.size) over (partition by t.rank order by b.key, b.size, b.doc_id rows between unbounded preceding and current row))::bigint as upto
  from base b join targets t on b.source is not distinct from t.source
),
queued as (
  select *, (e * source_size + upto)::double / target as finish
  from rows_, (values (0), (1), (2)) as c(e)
  where target > 0 and (e * source_size + upto - size)::double / target < 1
),
run as (
  select doc_id, size, total, sum(size) over (order by finish, rank, key, size, doc_id, e rows between unbounded preceding and current row) as run from queued
),
taken as (select doc_id, sum(size)::bigint as taken from run where run <= total group by doc_id)
select r.doc_id, r.size, r.source_size, r.target, coalesce(t.taken, 0)::bigint as taken
from rows_ r left join taken t on r.doc_id = t.doc_id
"""
