"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = store(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low")), "least")
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Of edges whose first end is the larger one."""
    least = store(edges.groupBy("a").agg(F.min("b").alias("low")), "least")
    moved = edges.join(least, "a").filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.union(least.select("a", F.col("low").alias("b")))


def connected(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``, root being the smallest node reachable.

    Every step is a pre-aggregated minimum and an equi-join, stored in the shared folder;
    only a count and a checksum of the edges reach the driver. The minima are stored before
    they are joined: Spark splits the edges of a node with very many of them only where both
    sides come straight from a shuffle. Edges may repeat, may run either way, and may be none.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, seen = store(edges, "edges"), None
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        # each star's output has its larger end first
        edges = store(_small_star(_large_star(edges).distinct()).distinct(), "edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
