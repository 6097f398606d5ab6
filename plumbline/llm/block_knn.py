"""Nearest neighbours by a block matrix join with int8 products and exact refinement.

Vectors are packed into tiles of rows. A vector is kept as its float values and as int8
codes ``q`` with one scale ``s`` (``s * q`` is within ``s / 2`` of it in every component),
together with the exact length of its rounding error. For a pair, the tile product of the
codes gives the approximate squared distance, and the triangle inequality bounds the true
distance: it differs from the distance of the decoded vectors by at most the sum of the two
errors. A tile pair keeps, for each query, the candidates whose lower bound does not exceed
the k-th smallest upper bound, so no true neighbour is lost; their distances are computed
again in double precision from the original values. Each tile pair sends k rows a query
at most, and the heaps of all tiles merge by a map-side top-k before the final ranks.

The set of queries is stated by the caller. Query tiles and groups of row tiles form a grid
whose cells are the keys of the join: queries against all rows, in blocks, without pairs of
rows and without a broadcast.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import settle

K = 10
TILE = 2048
TILES_PER_CELL = 4
_TILES = "tile long, ids binary, vectors binary, width int"


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales and the lengths of the rounding errors of the rows of ``x``."""
    top = np.abs(x).max(axis=1, initial=0.0)
    scale = np.where(top > 0, top / 127.0, 1.0)
    codes = np.rint(x / scale[:, None])
    error = np.sqrt(((x - codes * scale[:, None]) ** 2).sum(axis=1))
    return codes.astype(np.int8), scale, error


def _product(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact integer products of int8 rows: float32 holds sums below 2**24 without rounding."""
    out = np.zeros((len(left), len(right)), np.float64)
    for at in range(0, left.shape[1], 1024):  # 1024 * 127 * 127 < 2**24
        out += left[:, at : at + 1024].astype(np.float32) @ right[:, at : at + 1024].astype(np.float32).T
    return out


def tile_neighbours(
    query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int
) -> Iterator[tuple[int, list[tuple[float, int]]]]:
    """For every query, its ``k`` nearest rows of one tile as (distance, id), nearest first."""
    qc, qs, qe = quantise(queries)
    rc, rs, re = quantise(rows)
    dots = _product(qc, rc) * qs[:, None] * rs[None, :]
    q2 = (qc.astype(np.float64) ** 2).sum(axis=1) * qs**2
    r2 = (rc.astype(np.float64) ** 2).sum(axis=1) * rs**2
    squared = np.maximum(q2[:, None] + r2[None, :] - 2 * dots, 0.0)
    # Rounding of the sums themselves: a few units in the last place of the largest term.
    slack = np.sqrt(1e-12 * (q2[:, None] + r2[None, :]))
    near, spread = np.sqrt(squared), qe[:, None] + re[None, :] + slack
    other = ids[None, :] != query_ids[:, None]
    upper = np.where(other, near + spread, np.inf)
    k_here = min(k, len(ids))
    limit = np.partition(upper, k_here - 1, axis=1)[:, k_here - 1]
    survive = other & ~(near - spread > limit[:, None])
    for i in range(len(query_ids)):
        found = np.flatnonzero(survive[i])
        exact = np.sqrt(((rows[found] - queries[i]) ** 2).sum(axis=1))
        yield int(query_ids[i]), heapq.nsmallest(k, zip(exact.tolist(), ids[found].tolist(), strict=True))


def usable(vector: Column) -> Column:
    """Not null, empty or zero, and every component a finite number."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def tiles(rows: DataFrame, size: int) -> DataFrame:
    """``rows (id, vector)`` in tiles of at most ``size`` rows of one width."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in batches:
            vectors = batch.column("vector")
            width = np.asarray(pc.list_value_length(vectors))
            ids = batch.column("id").to_numpy(zero_copy_only=False).astype(np.int64)
            for w in np.unique(width):
                chosen = np.flatnonzero(width == w)
                for at in range(0, len(chosen), size):
                    some = chosen[at : at + size]
                    values = vectors.take(pa.array(some)).flatten().to_numpy(zero_copy_only=False)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([number], pa.int64()),
                            pa.array([ids[some].tobytes()], pa.binary()),
                            pa.array([values.astype(np.float64).tobytes()], pa.binary()),
                            pa.array([int(w)], pa.int32()),
                        ],
                        names=["tile", "ids", "vectors", "width"],
                    )
                    number += 1

    return rows.mapInArrow(run, _TILES)


def _numbered(found: DataFrame, name: str) -> DataFrame:
    """Tiles in the shared folder, numbered without gaps (one small row a tile is ordered)."""
    kept = settle(found.withColumn("key", F.monotonically_increasing_id()), name)
    numbers = kept.select("key", (F.row_number().over(Window.orderBy("key")) - 1).cast("long").alias("number"))
    return kept.join(numbers, "key").drop("key", "tile")


def _pairs(k: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for pair in frame.itertuples(index=False):
                query_ids, ids = np.frombuffer(pair.q_ids, np.int64), np.frombuffer(pair.ids, np.int64)
                queries = np.frombuffer(pair.q_vectors).reshape(len(query_ids), -1)
                rows = np.frombuffer(pair.vectors).reshape(len(ids), -1)
                found = [
                    (query, row, distance)
                    for query, near in tile_neighbours(query_ids, queries, ids, rows, k)
                    for distance, row in near
                ]
                yield pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    return run


def nearest(
    rows: DataFrame,
    is_query: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = K,
    tile: int = TILE,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows nearest to each query, exactly.

    Queries are the rows for which ``is_query`` (over the columns of ``rows``) holds; a
    query's own id is no candidate of it. Distances are Euclidean, in double precision on
    the original values; equal distances go to the smaller id. Vectors that are null, empty
    or zero, or hold a null or non-finite component, and rows with a null id take no part.
    Only vectors of equal width are compared. A repeated id is a candidate once for each
    different vector and a query once for each; fewer than ``k`` candidates are all returned.
    An empty table gives no rows.
    """
    # Kept apart from the caller's columns, whatever their names are.
    chosen = rows.select(
        rows[id_col].cast("long").alias("id"),
        rows[vector_col].cast("array<double>").alias("vector"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
    ).filter(F.col("id").isNotNull() & usable(F.col("vector"))).dropDuplicates(["id", "vector"])
    asked = _numbered(tiles(chosen.filter("asks").select("id", "vector"), tile), "queries")
    data = _numbered(tiles(chosen.select("id", "vector"), tile), "rows")
    # A grid of query tiles and groups of row tiles: every cell is one key of the join.
    groups = max(1, data.count() // TILES_PER_CELL)
    asked = asked.select(
        F.col("number").alias("block"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), "width"
    )
    numbers = asked.groupBy("width").agg(F.collect_list("block").alias("blocks"))
    placed = data.withColumn("part", F.pmod("number", F.lit(groups))).join(numbers, "width")
    placed = placed.withColumn("block", F.explode("blocks"))
    asked = asked.drop("width").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    pairs = placed.join(asked, ["block", "part"]).select("q_ids", "q_vectors", "ids", "vectors")
    found = pairs.mapInPandas(_pairs(k), "query_id long, vec_id long, score double").distinct()
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
