"""Connected components by alternating large and small stars, all in DataFrames.

Edges never come to the driver; each round is checkpointed in the shared folder, and a round's
count and hash sum tell whether the stars have settled. A node with very many neighbours is a
hot join key only: minima are pre-aggregated before their shuffle and written before they are
joined, so both sides of a join are fresh exchanges, whose crowded keys adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vantloom.runtime import checkpoint, without_estimates


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = checkpoint(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = checkpoint(down.groupBy("a").agg(F.min("b").alias("m")))
    joined = down.join(least, "a")
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b) pairs of one orderable type -> (node, root): root is the smallest node reachable.

    Only nodes that some edge touches are returned, and not the roots themselves. Pairs of
    equal ends and repeated pairs are harmless; an empty table gives an empty table.
    """
    edges = without_estimates(checkpoint(edges.select("a", "b").filter("a <> b").distinct()))
    state = None
    while True:
        edges = without_estimates(checkpoint(_small_star(checkpoint(_large_star(edges)))))
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state or not now[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now


def heads_of(stars: DataFrame, heads: DataFrame, head: str) -> DataFrame:
    """(node, ``head``): the smallest ``head`` of each node's component, for the nodes that ``stars`` (node, root) touch.

    ``heads`` has one row a node: (node, ``head``); null heads count for nothing.
    """
    touched = checkpoint(stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct()))
    least = checkpoint(touched.join(heads, "node").groupBy("root").agg(F.min(head).alias(head)))
    return touched.join(least, "root").select("node", head)
