"""Connected components of links, by alternating large-star and small-star rounds on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import textbuf as tb


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Every larger neighbour is tied to the least of a node and its neighbours."""
    all_ = _both(edges)
    least = all_.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    tied = tb.join_hot(all_.where("b > a"), least, ["a"], total=total)
    return tied.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """A node and its smaller neighbours are tied to the least of these."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    ties = tb.join_hot(down, least, ["a"], total=total).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return ties.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def connected(edges: DataFrame, scratch: tb.Scratch) -> DataFrame:
    """node and root (the least node of its component), for the nodes of the edges (a, b: long).

    Rounds go on until nothing changes. Hubs are never collected: both stars are a minimum by node
    and a join, whose hot nodes are dealt over several tasks. The edges of every round are written,
    which cuts the lineage.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = scratch.written(now, "edges")
    mark, total = None, now.count()
    while True:
        large = _large_star(now, total)
        if total >= tb.HOT_ROWS:
            # read more than once below
            large = scratch.written(large, "edges")
        now = scratch.written(_small_star(large, total), "edges")
        # finished when every node hangs on a root and no root hangs on anything
        got = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if got == mark:
            break
        mark, total = got, got[0]
    leaves = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return leaves.unionByName(leaves.select(F.col("root").alias("node"), "root").distinct())
