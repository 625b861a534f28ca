"""Connected components by alternating large-star and small-star rounds.

Each round is two aggregates and joins on the edge table, so a component of
any size is handled without collecting a group.  A node with more than 1 / ``HOT`` of
all edge ends gets its least neighbour by broadcast, and there are at most
2 * ``HOT`` such nodes whatever the graph; so no task of a join holds more than that share of
the edges for one node.  The edge table is written each round, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import Scratch

HOT = 500


def _with_least(ends: DataFrame, n_edges: int) -> DataFrame:
    """(a, b, m): ``m`` is the least b of each a."""
    least = ends.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    hot = least.where(F.col("n") > n_edges // HOT + 100).select("a", F.col("m").alias("hot"))
    marked = ends.join(F.broadcast(hot), "a", "left")
    cold = marked.where(F.col("hot").isNull()).select("a", "b").join(least.select("a", "m"), "a")
    return cold.unionByName(marked.where(F.col("hot").isNotNull()).select("a", "b", F.col("hot").alias("m")))


def _large_star(edges: DataFrame, n_edges: int) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # One row an edge, so what repeats can wait for the small star.
    return _with_least(both, n_edges).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.least("m", "a").alias("b"))


def _small_star(edges: DataFrame, n_edges: int) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    # The row of the least neighbour links the node itself, the others are linked to the least.
    return (_with_least(down, n_edges).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (a, b); component: its least node.

    Edges with a null end and loops are left out.  No edge, no row.
    """
    edges = scratch.table(edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _state(edges)
    while state[0]:
        new = scratch.table(_small_star(_large_star(edges, state[0]), state[0]), "edges")
        scratch.drop(edges)
        edges, old = new, state
        state = _state(edges)
        if state == old:
            break
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
