"""Connected components of a graph whose edges are rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywork.operators.stages import written


def _least(edges: DataFrame) -> DataFrame:
    """The least neighbour of each ``a``."""
    return edges.groupBy("a").agg(F.min("b").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """The least node reachable from each node that has a smaller one (node, root), from edges (a, b).

    Large-star and small-star steps in turn, until the edges stay as they are. A node's
    neighbours are never gathered: their least is aggregated and joined. Each round's edges
    are a table in the shared folder, which ends the lineage.
    """
    oriented = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    current, before = written(oriented, "edges"), None
    while True:
        state = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 31))).first()
        if state == before:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Large star: the greater neighbours of a node go to the least of its neighbourhood.
        large = both.join(_least(both), "a").where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        large = written(large, "edges")
        # Small star: a node and its smaller neighbours go to the least of these.
        small = large.join(_least(large), "a")
        small = small.select("a", F.col("m").alias("b")).unionByName(small.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        current = written(small.distinct(), "edges")
