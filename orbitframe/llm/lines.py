"""Removal of repeated windows of three consecutive lines, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from orbitframe.session import read_table, written_table

SPAN = 3


def _windows(docs: DataFrame, span: int) -> DataFrame:
    """(d, r, th, h1, h2, pos, again): windows of each document; again: not its first with these lines."""
    at = F.sequence(F.lit(0), F.size("lines") - span)

    def hashed(i):
        w = [F.get("lines", i + k) for k in range(span)]
        return F.struct(F.xxhash64(*w).alias("h1"), F.xxhash64(F.lit("second"), *w).alias("h2"), i.alias("pos"))

    w = docs.where(F.size("lines") >= span).select("d", "r", "th", F.array_sort(F.transform(at, hashed)).alias("w"))

    def marked(x, i):
        before = F.get("w", i - 1)
        again = (i > 0) & (before.h1 == x.h1) & (before.h2 == x.h2)
        return F.struct(x.h1.alias("h1"), x.h2.alias("h2"), x.pos.alias("pos"), F.coalesce(again, F.lit(False)).alias("again"))

    return w.select("d", "r", "th", F.inline(F.transform("w", marked)))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN) -> DataFrame:
    """The rows of docs with the text shortened, and columns n_lines and n_removed.

    Lines end at a line feed. Every window of ``span`` consecutive lines is hashed (128 bits); of
    windows with equal lines the first in order of (id, position) stays and the others are
    removed: the positions they cover, merged, leave the text. Each removed line has an equal one that
    stays earlier. A text of fewer lines has no window and stays as it is, as do null and empty
    texts (n_lines 0 for null, 1 for empty). Rows of equal id count as one document: they don't
    remove lines of one another, but each its own repeats. Rows of null ids come last and are a document each,
    told apart by a written row key. An empty table gives no rows.
    Other columns, whatever their names, stay; columns n_lines and n_removed of docs are replaced.
    Work on a text is in proportion to its lines, however many there are or go.
    A window in very many documents is counted before the shuffle, and its rows meet the count in a
    join that adaptive execution splits.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.col(f"`{id_col}`").cast("long").alias("d"), F.xxhash64(f"`{text_col}`").alias("th"))
    nameless = written_table(rows.where("d is null").withColumn("r", F.monotonically_increasing_id()))
    rows = rows.where("d is not null").withColumn("r", F.lit(-1).cast("long")).unionByName(nameless)
    text = F.col(f"row.`{text_col}`")
    w = _windows(rows.select("d", "r", "th", F.split(text, "\n", -1).alias("lines")), span)
    row = F.when(F.col("d").isNull(), F.col("r"))
    shared = w.where("not again").groupBy("h1", "h2").agg(F.min("d").alias("first"), F.max("d").alias("last"), F.min(row).alias("first_row"), F.max(row).alias("last_row"))
    shared = shared.where("first < last or first_row < last_row or (first is not null and first_row is not null)")
    later = w.where("not again").join(shared, ["h1", "h2"]).where("d > first or (d is null and (first is not null or r > first_row))").select("d", "r", "th", "pos")
    later = later.union(w.where("again").select("d", "r", "th", "pos"))
    cover = later.groupBy("d", "r", "th").agg(F.collect_set("pos").alias("starts")).withColumnsRenamed({"d": "cd", "r": "cr", "th": "cth"})
    on = F.col("d").eqNullSafe(F.col("cd")) & (F.col("r") == F.col("cr")) & (F.col("th") == F.col("cth"))
    out = rows.join(cover, on, "left").withColumn("lines", F.split(text, "\n", -1))
    out = out.withColumn("gone", F.array_distinct(F.flatten(F.transform("starts", lambda p: F.sequence(p, p + span - 1)))))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")  # a hash set, not a search for each line
    kept = F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n")
    shown = [F.when(F.col("gone").isNull(), text).otherwise(kept).alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in names]
    count = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("long")
    return out.select(*shown, count("lines").alias("n_lines"), count("gone").alias("n_removed"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", "text")


OP5_SQL = """
with d as (select doc_id, text, string_split(text, chr(10)) as ls from documents),
w as (
  select doc_id, p, ls[p + 1] || chr(10) || ls[p + 2] || chr(10) || ls[p + 3] as h
  from (select doc_id, ls, unnest(range(0, len(ls) - 2)) as p from d where len(ls) >= 3)
),
later as (
  select doc_id, p from (select doc_id, p, row_number() over (partition by h order by doc_id, p) as rn from w) where rn > 1
),
gone as (select distinct doc_id, p + k as p from later, (values (0), (1), (2)) as s(k)),
l as (select doc_id, unnest(ls) as line, unnest(range(0, len(ls))) as p from d),
kept as (
  select l.doc_id, count(*) as n_lines, count(g.p) as n_removed,
    coalesce(string_agg(case when g.p is null then l.line end, chr(10) order by l.p), '') as text
  from l left join gone g on l.doc_id = g.doc_id and l.p = g.p group by l.doc_id
)
select d.doc_id, coalesce(k.n_lines, 0) as n_lines, coalesce(k.n_removed, 0) as n_removed,
  case when d.text is null then null else k.text end as text
from d left join kept k on d.doc_id = k.doc_id
"""
