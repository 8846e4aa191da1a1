"""The corpus pipeline: toxicity, line dedup, near-dedup, mixing, encoding."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from orbitframe.llm import lines, mixing, pieces, simhash, toxicity
from orbitframe.session import ensure_checkpoint_dir, read_table, written_table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
ORACLE_SQL = None


def _columns(df: DataFrame) -> DataFrame:
    return df.select(*COLUMNS[:-1], F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n_chars"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold.

    Scores travel with the rows, so nothing is joined: rows that share an id, or have none, are judged by
    their own text, and repeated rows alike. Null and empty texts have a score as any other and stay where it is
    low; long texts are scored whole. Without labels of both kinds the score is the share of toxic ones.
    Columns besides COLUMNS are left out; an empty table gives no rows.
    """
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    return model.keep(docs.select(*COLUMNS), toxicity.THRESHOLD)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later occurrences of three-line windows; a text that loses all lines goes with them.

    The first occurrence by id (null last) stays, so ties are only within an id, whose rows don't touch one another. Null
    and empty texts and those of fewer lines stay as they are; long texts are worked through whole. n_chars is
    counted anew. Columns besides COLUMNS are left out; an empty table gives no rows.
    """
    out = lines.line_dedup(docs.select(*COLUMNS))
    return _columns(out.where("n_removed = 0 or n_removed < n_lines"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, also where rows share an id or have none.

    It is the first by id (null last), text hash and row. Null and empty texts are one group; repeated rows
    leave one; long texts are fingerprinted whole. Columns besides COLUMNS are left out; an empty table gives no rows.
    """
    return simhash.one_of_each_group(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, three times at most; documents without words (null, empty) aren't taken.

    Rows have keys of their own, so each has the copies the mix gave it, whether ids are null, shared or repeated; the
    whole never passes the sum of all words. Ties are in the order of mix. Null sources are a source. Columns besides COLUMNS
    are left out; an empty table gives no rows.
    """
    keyed = written_table(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("key")))
    taken = mixing.mix(keyed, name_col="key").where("taken > 0").select(F.col("name").alias("key"), F.expr("cast(taken div size as int)").alias("times"))
    return keyed.join(taken, "key").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, byte spans and decoded text's digest of every row that the mix took, repeats included.

    Null texts are empty ones (two marks), null ids stay null, long texts are encoded whole; other columns are left out;
    an empty table gives no rows.
    """
    e = pieces.encode_documents(docs)
    return e.select(F.col("id").alias("doc_id"), "ids", F.col("starts").alias("piece_starts"), F.col("ends").alias("piece_ends"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("source_mixing", mix_sources),
    ("sentencepiece", encode),
]


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each but the last is written in the shared checkpoint folder and read again.

    A stage's input folder goes once its output is written; that of the last stage stays, since the
    result is read from it.
    """
    folder = os.path.join(ensure_checkpoint_dir(spark), f"pipeline-{uuid.uuid4().hex}")
    docs, before = read_table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            at = f"{folder}/{k}-{name}"
            docs.write.parquet(at)
            docs = spark.read.parquet(at)
            if before:
                _remove(spark, before)
            before = at
    return docs
