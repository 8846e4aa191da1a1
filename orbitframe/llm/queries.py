"""The registered queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orbitframe.llm import embeddings, lines, mixing, owners, passages, pieces, runs, secrets, simhash, spelling, toxicity, urls, winnowing


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        secrets.op1_secret_scan,
        pieces.op2_sentencepiece,
        simhash.op3_simhash_near_dedup,
        toxicity.op4_toxicity,
        lines.op5_line_dedup,
        mixing.op6_source_mixing,
        passages.op7_substring_dedup,
        winnowing.op8_winnowing,
        embeddings.op9_embedding_near_dedup,
        urls.op10_url_filters,
        owners.op11_exact_dedup,
        spelling.op12_spelling_variants,
        runs.op13_periodic_runs,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op5_line_dedup": lines.OP5_SQL, "op6_source_mixing": mixing.OP6_SQL, "op9_embedding_near_dedup": embeddings.OP9_SQL, "op11_exact_dedup": owners.OP11_SQL}
