"""Connected components of a distributed graph by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewise.llm.common import cut


def _lowest(pairs: DataFrame) -> DataFrame:
    """``pairs`` (u, v) plus ``m``, the lowest of u and its neighbours. A hub's rows are summed before they move."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "of")
    return pairs.join(least, F.col("u") == F.col("of")).select("u", "v", F.least("u", "m").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for each node of ``edges`` (u, v): the root is the lowest node that can be reached.

    Each round hangs the larger neighbours of every node, then the smaller ones, on the lowest node near; the number of
    rounds grows with the logarithm of the longest path. Rounds end in a checkpoint. They are over when no node with a
    higher neighbour has a lower one too: then every edge leads to a root, and no two trees touch.
    """
    held = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), few=True)
    while True:
        # Edges lead from a node to a lower one. A forest of stars has one edge for each node that is no root.
        several = held.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u")
        inner = held.select("v").distinct().join(held.select(F.col("u").alias("v")).distinct(), "v", "left_semi").select(F.col("v").alias("u"))
        if several.union(inner).isEmpty():
            roots = held.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
            return held.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
        both = held.union(held.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _lowest(both).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        near = _lowest(large)
        small = near.select("u", F.col("m").alias("v")).union(near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        held = cut(small.distinct(), few=True)
