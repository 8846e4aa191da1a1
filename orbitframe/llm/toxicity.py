"""Toxicity: gradient-boosted trees over dense text features, calibrated by isotonic regression."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from orbitframe.llm.batches import bound_batches, text_parts
from orbitframe.session import cut_lineage, read_table

#: Labelled rows that are used at most (those of the least hashes), and words the lexicon learns at most.
MAX_LABELLED, MAX_LEXICON = 24_000, 3_000
THRESHOLD = 0.3

#: Insults that count before any label is seen.
SEED_LEXICON = ("idiot", "moron", "stupid", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "clown", "dumb", "hate", "filth", "vermin", "garbage", "freak", "imbecile", "dumbass", "bastard", "bitch", "shit", "fuck", "asshole", "retard")
SECOND_PERSON = ("you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "tu", "te", "toi", "ton", "ta", "vous", "votre", "tú", "ti", "usted", "ustedes", "vosotros", "vuestro")
#: Characters that stand for letters in disguised words.
LEET = str.maketrans("013457@$!|€", "oieastasile")
NEAR = 5
FEATURES = (
    "words", "hits_density", "hits", "weight_density", "max_weight", "second_density", "near_second", "near_second_density", "prefix_density", "prefix_max",
    "disguised_hits", "disguised_density", "capital_rate", "capital_words", "exclaim_rate", "question_rate", "punctuation_rate", "symbol_rate", "repeat_rate", "spaced_letters",
)

_WORD = re.compile(r"[^\W\d_]+")
_LOOSE = re.compile(r"[^\W\d_][013457@$!|€]+[^\W\d_]|\b[013457@$|€]+[^\W\d_]")
_DISGUISE = re.compile(r"[013457@$!|€]")
_CAPITALS = re.compile(r"[A-ZÀ-ÖØ-Þ]{2,}")
_SECOND = frozenset(SECOND_PERSON)


class Lexicon(dict):
    """What a lower-case word says: (weight, weight of its start, second person, single letter), or None for nothing.

    weights has words, and word starts of 4 or 5 letters written with a trailing star. Words once seen are
    kept, a bounded number of them.
    """

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> tuple[float, float, bool, bool] | None:
        get = self.weights.get
        start = max(get(word[:4] + "*", 0.0), get(word[:5] + "*", 0.0)) if len(word) > 4 else 0.0
        said = (get(word, 0.0), start, word in _SECOND, len(word) == 1)
        said = said if any(said) else None
        if len(self) < 1 << 17:
            self[word] = said
        return said


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _disguised(low: str, weights: dict[str, float]) -> int:
    """Tokens that are a word of the lexicon once digits and signs that stand for letters are read as these."""
    if not _DISGUISE.search(low):
        return 0
    n = 0
    for token in low.split():
        if not token.isalpha() and _LOOSE.search(token := token.strip("*$%&#.,;:!?\"'()")):
            n += weights.get("".join(c for c in token.translate(LEET) if c.isalpha()), 0.0) > 0
    return n


def features(text: str, lexicon: Lexicon) -> list[float]:
    """The dense features of a text, in the order of FEATURES; of an empty text all are 0.

    Work is in proportion to the text's length.
    """
    if not text:
        return [0.0] * len(FEATURES)
    low = text.lower()
    words = _WORD.findall(low)
    n, size = max(1, len(words)), len(text)
    said = [(i, x) for i, x in enumerate(map(lexicon.__getitem__, words)) if x]
    hits = [(i, x[0]) for i, x in said if x[0] > 0]
    starts = [x[1] for _, x in said if x[1] > 0]
    second = [i for i, x in said if x[2]]
    near = 0
    if hits and second:
        at, you = np.array([i for i, _ in hits]), np.array([-NEAR - 1, *second, len(words) + NEAR])
        after = np.searchsorted(you, at)
        near = int(np.count_nonzero((you[after] - at <= NEAR) | (at - you[after - 1] <= NEAR)))
    single = np.array([i for i, x in said if x[3]])
    spaced = np.count_nonzero((single[3:] - single[:-3] == 3)) if len(single) > 3 else 0
    letters = sum(map(len, words)) or 1
    codes, plain = _codes(text), _codes(low)
    capitals = int(np.count_nonzero(codes != plain)) if len(codes) == len(plain) else sum(map(str.isupper, text))
    tripled = plain[2:][(plain[2:] == plain[1:-1]) & (plain[2:] == plain[:-2])]
    repeats = int(np.count_nonzero((tripled >= 97) & (tripled != 0xD7) & (tripled != 0xF7) & ((tripled <= 122) | (tripled >= 0xC0))))
    marks = size - letters - sum(map(text.count, " \n\t"))
    disguised = _disguised(low, lexicon.weights)
    weights = [x for _, x in hits]
    return [
        math.log1p(len(words)), len(hits) / n, math.log1p(len(hits)), sum(weights) / n, max(weights, default=0.0), len(second) / n, float(near), near / n,
        len(starts) / n, max(starts, default=0.0), float(disguised), disguised / n, capitals / letters, len(_CAPITALS.findall(text)) / n,
        text.count("!") / n, text.count("?") / n, marks / size, sum(map(text.count, "*#$%&@")) / n, repeats / n, float(spaced),
    ]


def with_features(df: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    """df's other columns and x array<double>, the features of its column text; a row in, a row out."""
    names, at = df.columns, df.columns.index("text")
    names.pop(at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Lexicon(lexicon)
        for b in batches:
            x = [features(t or "", known) for _, part in text_parts(b, at) for t in part]
            x = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES)), pa.array(np.array(x, float).ravel()))
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(b.columns) if i != at), x], names=[*names, "x"])

    bound_batches(df.sparkSession)
    return df.mapInArrow(run, StructType([*(f for i, f in enumerate(df.schema) if i != at), StructField("x", ArrayType(DoubleType()))]))


def text_features(df: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    """(id, label, x array<double>) of df's id, label and text."""
    return with_features(df.select("id", "label", "text"), lexicon)


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def learned_lexicon(labelled: DataFrame, least: int = 3) -> dict[str, float]:
    """Weights of words and word starts that toxic texts have more often, MAX_LEXICON at most.

    A weight is the log ratio of the shares of toxic and other texts that have the word, smoothed.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]+"), 0))
    long = F.filter(words, lambda w: F.length(w) > 4)
    starts = F.concat(F.transform(long, lambda w: F.concat(F.substring(w, 1, 4), F.lit("*"))), F.transform(long, lambda w: F.concat(F.substring(w, 1, 5), F.lit("*"))))
    seen = labelled.select("label", F.explode(F.concat(words, F.array_distinct(starts))).alias("w"))
    total = labelled.agg(F.sum("label"), F.sum(1 - F.col("label"))).first()
    bad, fine = float(total[0] or 0), float(total[1] or 0)
    counts = seen.groupBy("w").agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b")).where(F.col("a") >= least)
    weight = F.log((F.col("a") + 0.1) / (bad + 1)) - F.log((F.col("b") + 0.5) / (fine + 1))
    top = counts.withColumn("k", weight).where("k > 1.5").orderBy(F.desc("k"), F.desc("a"), "w").limit(MAX_LEXICON)
    return {r.w: r.k for r in top.collect()}


class ToxicityModel:
    """A fitted lexicon, trees and calibration; ``score`` gives (id, score) of any rows."""

    def __init__(self, lexicon: dict[str, float], trees, calibration, prior: float):
        self.lexicon, self.trees, self.calibration, self.prior = lexicon, trees, calibration, prior

    def _margins(self, df: DataFrame) -> DataFrame:
        rows = self.trees.transform(df.withColumn("features", array_to_vector("x")))
        return rows.select("id", "label", vector_to_array("rawPrediction")[1].alias("margin"))

    def score(self, df: DataFrame) -> DataFrame:
        """(id, score) of the rows of df (id, text); empty and null texts get a score too."""
        if self.trees is None:
            return df.select("id", F.lit(self.prior).alias("score"))
        m = self._margins(text_features(df.withColumn("label", F.lit(0.0)), self.lexicon))
        return self._scored(m).select("id", "score")

    def keep(self, docs: DataFrame, threshold: float, text_col: str = "text") -> DataFrame:
        """The rows of docs, whatever their columns, whose score is below ``threshold``; null texts are empty ones."""
        if self.trees is None:
            return docs.where(F.lit(self.prior < threshold))
        row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
        rows = with_features(docs.select(row.alias("row"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")), self.lexicon)
        m = self.trees.transform(rows.select("row", array_to_vector("x").alias("features")))
        m = m.select("row", vector_to_array("rawPrediction")[1].alias("margin"))
        return self._scored(m).where(F.col("score") < threshold).select("row.*")

    def _scored(self, margins: DataFrame) -> DataFrame:
        # The calibration is flat in steps; a thousandth of the trees' own probability keeps their order within a step.
        p = 1 / (1 + F.exp(-2 * F.col("margin")))
        steps = F.least(F.greatest("prediction", F.lit(0.0)), F.lit(1.0))
        return self.calibration.transform(margins).withColumn("score", 0.999 * steps + 0.001 * p)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Fit on labelled documents whose id isn't held out, MAX_LABELLED of the least id hashes at most.

    A third of them each, by hash, is for the lexicon, the trees and the calibration, so that no part
    is fitted on what an earlier one has seen. Ids only split and join. Null labels are left out,
    of several labels of an id the largest counts. If a third lacks one of the labels, all rows
    serve all three; without rows of both labels the score is the share of toxic ones, or 0.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).cast("long").alias("lid")).agg(F.max(label_col).cast("double").alias("label"))
    known = known.orderBy(F.xxhash64("lid"), "lid").limit(MAX_LABELLED)  # a bounded table, so it may be broadcast
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(known), F.col("id") == F.col("lid")).select("id", "label", "text", F.pmod(F.xxhash64(F.col("id"), F.lit("third")), F.lit(3)).alias("third"))
    rows = cut_lineage(rows)
    counts = {(r.third, r.label): r["count"] for r in rows.groupBy("third", "label").count().collect()}
    n = sum(counts.values())
    prior = sum(c for (_, y), c in counts.items() if y > 0) / n if n else 0.0
    if prior in (0.0, 1.0):
        return ToxicityModel({}, None, None, prior)
    apart = all(counts.get((k, y)) for k in range(3) for y in (0.0, 1.0))
    lexicon = {w: 3.0 for w in SEED_LEXICON} | learned_lexicon(rows.where("third = 0") if apart else rows)
    rest = cut_lineage(text_features(rows.where("third > 0") if apart else rows, lexicon).withColumn("third", F.pmod(F.xxhash64(F.col("id"), F.lit("third")), F.lit(3))))
    trees = GBTClassifier(featuresCol="features", labelCol="label", maxIter=24, maxDepth=3, stepSize=0.3, maxBins=32, minInstancesPerNode=3, seed=1)
    fitted = trees.fit((rest.where("third = 1") if apart else rest).select("label", array_to_vector("x").alias("features")))
    model = ToxicityModel(lexicon, fitted, None, prior)
    margins = model._margins(rest.where("third = 2") if apart else rest)
    model.calibration = IsotonicRegression(featuresCol="margin", labelCol="label").fit(margins)
    return model


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row of docs; see fit and ToxicityModel.score.

    Null and empty texts have the score of a text without features; very long ones are read whole. Null
    ids stay and are never labelled; rows of an id that has a label all serve, repeated ones too. Ties stay ties.
    Other columns, whatever their names, aren't read; an empty table gives no rows.
    """
    model = fit(docs, labels, id_col, text_col)
    return model.score(docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = toxicity_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return scores.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
