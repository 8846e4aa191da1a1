"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from orbitframe.session import cut_lineage


def _distinct_edges(edges: DataFrame) -> DataFrame:
    """Edges (a, b) with a > b, each once."""
    return (
        edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable id of every vertex of ``edges`` (a long, b long).

    Returns (id, component); a vertex without an edge to another one has no row. Each round maps
    every larger neighbour of a vertex to the vertex's smallest neighbour, then every smaller one,
    as aggregates and joins on the vertex, so a hub with very many neighbours is summed on the map
    side and its join is one that adaptive execution can split. The number of rounds is about the
    logarithm of the longest path. Null ends and self loops are ignored; no edges give no rows.
    """
    e = cut_lineage(_distinct_edges(edges))
    seen = None
    for _ in range(max_rounds):
        # Large star: each neighbour above u is tied to the least of u and its neighbours.
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.least("u", "m").alias("b"))
        large = _distinct_edges(large)
        # Small star: u and its smaller neighbours are tied to the least of these neighbours.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        e = cut_lineage(_distinct_edges(small))
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = e.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return stars.union(e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
