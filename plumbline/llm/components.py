"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import discard, settle


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    tied = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are tied to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    tied = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def _all_stars(edges: DataFrame) -> bool:
    """Whether every node is either the centre of its edges or tied to one centre."""
    ends = edges.selectExpr("a AS node", "1 AS tied", "0 AS centre").unionByName(
        edges.selectExpr("b AS node", "0 AS tied", "1 AS centre")
    )
    nodes = ends.groupBy("node").agg(F.sum("tied").alias("tied"), F.max("centre").alias("centre"))
    return nodes.filter("tied + centre > 1").isEmpty()


def components(edges: DataFrame, name: str = "stars") -> DataFrame:
    """``node, root`` for every node of ``edges (a, b)``; ``root`` is the smallest node it reaches.

    Each round is two grouped minima and two joins, written to the shared folder, and
    the number of rounds grows with the logarithm of the longest chain. The table of the round
    before is deleted. Nothing is collected but whether only stars are left, which ends the rounds.
    Nodes must not be null; self loops and repeated edges are ignored.
    """
    edges = settle(edges.filter("a <> b").distinct(), name)
    while True:
        before, edges = edges, settle(_small_star(_large_star(edges)), name)
        discard(before)
        if _all_stars(edges):
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
