"""Near-duplicate vectors: spherical k-means cells and blocked cosine products."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from orbitframe.llm.blocks import block_pairs, forest
from orbitframe.llm.components import connected_components
from orbitframe.session import cut_lineage, read_table

#: Vectors of a cell, about; cells at most; sampled vectors for a cell's fit, and in all; rows of a block.
CELL_ROWS, MAX_CELLS, SAMPLE, FIT_ROWS, BLOCK = 4_096, 16_384, 64, 65_536, 4_096


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """k unit centres of unit rows x: Lloyd rounds on cosine; an empty cell keeps its centre."""
    rng = np.random.default_rng(seed)
    c = x[np.sort(rng.choice(len(x), size=min(k, len(x)), replace=False))]
    for _ in range(rounds):
        home = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, home, x)
        norms = np.linalg.norm(sums, axis=1)
        c = np.where(norms[:, None] > 1e-12, sums / np.maximum(norms, 1e-12)[:, None], c)
    return c


def _valid(vec: str) -> F.Column:
    v = F.col(vec)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    """Unit rows in double precision; scaled first, so that no square overflows or vanishes."""
    x = np.asarray(vectors.flatten()).reshape(len(vectors), dim)
    return unit_rows(x / np.abs(x).max(axis=1, keepdims=True))


def _fit(classes: DataFrame, n: int) -> tuple[int, np.ndarray]:
    """The commonest vector length of a sample, and centres fitted on it: SAMPLE rows a cell, FIT_ROWS at most, of the least hashes."""
    k = min(MAX_CELLS, max(1, math.ceil(n / CELL_ROWS)))
    rows = [r.vec for r in classes.orderBy("h1", "h2").limit(min(FIT_ROWS, max(1_024, SAMPLE * k))).select("vec").collect()]
    dim = max({len(v) for v in rows}, key=lambda d: (sum(len(v) == d for v in rows), d))
    x = np.array([v for v in rows if len(v) == dim], float)
    return dim, spherical_kmeans(unit_rows(x / np.abs(x).max(axis=1, keepdims=True)), k)


def block_links(x: np.ndarray, left: np.ndarray, right: np.ndarray, weights: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(links, root) of unit rows: weights of the rows on the other side at cosine ``threshold`` or more, and the least row each is connected to.

    Products are screened in single precision, whose error is bounded, and decided in double.
    """
    n, rights, slack = len(x), np.flatnonzero(right), 2e-7 * (x.shape[1] + 16)
    small = x.astype(np.float32)
    there, links, root = small[rights].T.copy(), np.zeros(n), np.arange(n)
    lefts = np.flatnonzero(left)
    for lo in range(0, len(lefts), 256):
        rows = lefts[lo : lo + 256]
        hit = small[rows] @ there >= np.float32(threshold - slack)
        hit &= ~left[rights] | (rights > rows[:, None])  # within a block each pair once
        if np.count_nonzero(hit) > 20_000:
            hit &= x[rows] @ x[rights].T >= threshold
            a, b = hit.nonzero()
        else:
            a, b = hit.nonzero()
            fine = np.einsum("ij,ij->i", x[rows[a]], x[rights[b]]) >= threshold
            a, b = a[fine], b[fine]
        a, b = rows[a], rights[b]
        links += np.bincount(a, weights[b], n) + np.bincount(b, weights[a], n)
        apart = root[a] != root[b]
        if apart.any():
            root = forest(n, np.concatenate((a[apart], np.arange(n))), np.concatenate((b[apart], root)))
    return links.astype(np.int64), root


def similar_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.9, margin: float | None = None) -> DataFrame:
    """(id, n_links, component, kept) of every row.

    Links are pairs of vectors of cosine ``threshold`` or more, in double precision. Cells of
    spherical k-means, as many as CELL_ROWS asks for, are fitted on a bounded sample; every vector has its nearest cell
    as home, and is a guest in each cell of a lower number whose border is within ``margin`` of it, so a
    pair across a border meets once. Two linked vectors lie at most sin(acos(threshold)) apart along
    a border's direction; that bound, which loses no pair, is what margin None takes. A smaller margin
    makes fewer guests and can lose links. Cells are compared in pairs of blocks, which give out each
    vector's count and one edge to its group's least member there, never all pairs. Where cells
    don't separate the vectors, every pair of blocks is compared.

    Vectors that are null, empty, zero, or hold null, NaN or infinite components link with nothing;
    neither do vectors of different lengths. Equal vectors are compared once and count as links of
    each other. Null ids stay and name a component only if all of the group's are null. Other columns,
    whatever their names, aren't read; an empty table gives no rows.
    """
    src = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("vec"))
    src = src.withColumn("ok", _valid("vec"))
    good = src.where("ok").withColumns({"h1": F.xxhash64("vec"), "h2": F.xxhash64(F.lit("second"), "vec")})
    classes = cut_lineage(good.groupBy("h1", "h2").agg(F.first("vec").alias("vec"), F.min("id").alias("rep"), F.count("*").alias("n")).withColumn("cid", F.monotonically_increasing_id()))
    total = classes.count()
    if total == 0:
        return src.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"), F.lit(True).alias("kept"))
    dim, centres = _fit(classes, total)
    reach = math.sin(math.acos(threshold)) if margin is None else margin

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.list_value_length(batch["vec"])
            other = batch.filter(pc.not_equal(lengths, dim))
            if len(other):
                cell = pc.negate(pc.cast(pc.list_value_length(other["vec"]), pa.int64()))
                yield pa.RecordBatch.from_arrays([*other.columns, cell, pa.array([False] * len(other))], names=names)
            batch = batch.filter(pc.equal(lengths, dim))
            for lo in range(0, len(batch), 512):
                part = batch.slice(lo, 512)
                s = _matrix(part["vec"], dim) @ centres.T
                at = np.arange(len(part))
                home = s.argmax(axis=1)
                width = np.sqrt(np.maximum(0, 2 - 2 * (centres[home] @ centres.T)))
                near = (s[at, home][:, None] - s <= reach * width + 1e-9) & (np.arange(len(centres))[None] < home[:, None])
                row, cell = near.nonzero()
                row, cell, guest = np.concatenate((at, row)), np.concatenate((home, cell)), np.arange(len(at) + len(row)) >= len(at)
                for k in range(0, len(row), 4096):
                    some = part.take(pa.array(row[k : k + 4096]))
                    yield pa.RecordBatch.from_arrays([*some.columns, pa.array(cell[k : k + 4096], pa.int64()), pa.array(guest[k : k + 4096])], names=names)

    names = ["cid", "n", "vec", "cell", "guest"]
    dealt = classes.select("cid", "n", "vec").mapInArrow(place, "cid long, n long, vec array<double>, cell long, guest boolean")
    pairs = block_pairs(dealt, "cell", "guest", "cid", BLOCK, few=True)

    def compare(table: pa.Table) -> pa.Table:
        vec, cid = table["vec"].combine_chunks(), np.asarray(table["cid"])
        x = _matrix(vec, len(vec[0]))
        links, root = block_links(x, np.asarray(table["left"]), np.asarray(table["right"]), np.asarray(table["n"]), threshold)
        has = links > 0
        return pa.table({"cid": cid[has], "links": links[has], "root": cid[root[has]]})

    found = cut_lineage(pairs.select("cell", "lo", "hi", "cid", "n", "vec", "left", "right").groupBy("cell", "lo", "hi").applyInArrow(compare, "cid long, links long, root long"))
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    comps = connected_components(found.select(F.col("cid").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "cid")
    known = classes.select("cid", "h1", "h2", "rep", "n").join(links, "cid", "left").join(comps, "cid", "left")
    known = known.select("h1", "h2", "rep", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "cid").alias("comp"))
    least = known.groupBy("comp").agg(F.min("rep").alias("component"))
    known = known.join(least, "comp").select("h1", "h2", "n_links", "component")
    out = good.select("id", "h1", "h2").join(known, ["h1", "h2"]).select("id", "n_links", "component", F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))
    return out.unionByName(src.where("not ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"), F.lit(True).alias("kept")))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = similar_vectors(read_table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


OP9_SQL = """
with recursive v as (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda x: coalesce(x::double, 0)) as e,
    embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
      and len(list_filter(embedding, lambda x: x <> 0)) > 0 as ok
  from embeddings
),
u as (select r, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) as n from v where ok),
link as (select a.r as a, b.r as b from u a join u b on a.r <> b.r and case when len(a.e) = len(b.e) then list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9 else false end),
reach(a, b) as (select r, r from v union select reach.a, link.b from reach join link on reach.b = link.a),
comp as (select reach.a as r, min(v.vec_id) as component_id from reach join v on reach.b = v.r group by reach.a),
links as (select a as r, count(*) as n from link group by a)
select v.vec_id, coalesce(links.n, 0)::bigint as n_links, comp.component_id, v.vec_id = comp.component_id as kept
from v join comp on v.r = comp.r left join links on v.r = links.r
"""
