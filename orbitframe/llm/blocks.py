"""Comparing the members of a group in pairs of bounded blocks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from orbitframe.session import cut_lineage

#: Keys whose sizes are broadcast at most. A key with more than one row in so many is joined apart.
MAX_BROADCAST, HOT_SHARE = 100_000, 256


def block_pairs(rows: DataFrame, key: str, guest: str | None, id_col: str, size: int, few: bool = False) -> DataFrame:
    """Rows dealt into tasks (key, lo, hi) that together compare each pair of a key once.

    A key's own rows are split by hash into blocks of about ``size``, its guests likewise; a task
    holds one own block (lo) with one other own block or guest block (hi), so no task grows with the key.
    Guests aren't compared with each other. ``left`` and ``right`` mark a row's side in its task; in a
    task of one block (lo = hi) rows are on both. A key with a single own row and no guest is dropped.
    ``few``: there are few keys, whose sizes are counted first and broadcast up to MAX_BROADCAST of them.
    """
    g = F.col(guest) if guest else F.lit(False)
    sizes = rows.groupBy(key).agg(F.count_if(~g).alias("_own"), F.count_if(g).alias("_guests"))
    sizes = sizes.where("_own > 1 or (_own > 0 and _guests > 0)")
    blocks = lambda c: F.ceil(F.col(c) / F.lit(size)).cast("long")
    sizes = sizes.select(key, blocks("_own").alias("_no"), blocks("_guests").alias("_ng"))
    if few:
        sizes = cut_lineage(sizes)
        if sizes.count() <= MAX_BROADCAST:
            sizes = F.broadcast(sizes)  # so that no task gets a key's rows
    r = rows.join(sizes, key)
    at = F.pmod(F.xxhash64(id_col), F.when(g, F.col("_ng")).otherwise(F.col("_no")))
    r = r.withColumn("_b", at + F.when(g, F.col("_no")).otherwise(F.lit(0)))
    all_own = F.sequence(F.lit(0).cast("long"), F.col("_no") - 1)
    all_guests = F.when(F.col("_ng") > 0, F.sequence(F.col("_no"), F.col("_no") + F.col("_ng") - 1)).otherwise(F.expr("cast(array() as array<bigint>)"))
    partner = F.when(g, all_own).otherwise(F.concat(all_own, all_guests))
    r = r.withColumn("_p", F.explode(partner))
    r = r.withColumns({"lo": F.least("_b", "_p"), "hi": F.greatest("_b", "_p")})
    return r.withColumns({"left": F.col("_b") == F.col("lo"), "right": F.col("_b") == F.col("hi")}).drop("_no", "_ng", "_b", "_p")


def join_spread(rows: DataFrame, table: DataFrame, key: str, count: str, *spread: str) -> DataFrame:
    """rows with the columns of table (a row for each key, and its number of rows in ``count``), null where it has none.

    Keys with more than one row in HOT_SHARE, of which there are fewer than HOT_SHARE, are broadcast; their rows, and those
    of null keys, are dealt by ``spread`` in the join that brings the others, so no task gets a key's rows.
    """
    table = cut_lineage(table)
    total = table.agg(F.sum(count)).first()[0] or 0
    more = [c for c in table.columns if c not in (key, count)]
    of = lambda hot, name: table.where((F.col(count) * HOT_SHARE > total) == hot).select(F.col(key).alias(f"_{name}"), *(F.col(c).alias(f"_{name}_{c}") for c in more))
    out = rows.join(F.broadcast(of(True, "hot")), F.col(key) == F.col("_hot"), "left")
    salt = F.when(F.col("_hot").isNotNull() | F.col(key).isNull(), F.pmod(F.xxhash64(*spread), F.lit(1 << 20)) + 1).otherwise(0)
    rest = of(False, "rest").withColumn("_at", F.lit(0).cast("long"))
    out = out.withColumn("_salt", salt).join(rest, (F.col(key) == F.col("_rest")) & (F.col("_salt") == F.col("_at")), "left")
    return out.select(*rows.columns, *(F.coalesce(f"_hot_{c}", f"_rest_{c}").alias(c) for c in more))


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node it is connected to by edges a-b."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (root != (up := root[root])).any():
            root = up
        keep = root[a] != root[b]
        a, b = a[keep], b[keep]
    return root
