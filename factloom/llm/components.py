"""Connected components of links between rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch

BROADCAST_ROWS = 1_000_000


def near(df: DataFrame) -> DataFrame:
    """df to be broadcast if it has at most BROADCAST_ROWS rows, and as it is beyond."""
    return F.broadcast(df) if scratch.small(df, BROADCAST_ROWS) else df


def components(links: DataFrame) -> DataFrame:
    """(node, root) for all nodes of links (a, b): root is the smallest node that links reach.

    Each round hangs every root below its smallest neighbour, follows the paths to
    their ends and draws the links together; links within a component vanish, and
    of the roots that have links at most half stay. No component meets in one task:
    neighbours' minima are aggregated before they are moved.
    """
    edges = scratch.keep(links.select("a", "b").where("a != b").distinct(), "links")
    labels = scratch.keep(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().select("node", F.col("node").alias("root")), "labels")
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        up = scratch.keep(both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("p")), "up")
        while True:  # each step halves the paths
            next_ = near(up.select(F.col("a").alias("p"), F.col("p").alias("q")))
            before, up = up, scratch.keep(up.join(next_, "p").select("a", F.col("q").alias("p"), (F.col("p") != F.col("q")).alias("moved")), "up")
            scratch.drop(before)
            if up.where("moved").isEmpty():
                break
        step = near(up.select("a", "p"))
        before = labels, edges, up
        labels = scratch.keep(labels.join(step, F.col("root") == F.col("a"), "left").select("node", F.coalesce("p", "root").alias("root")), "labels")
        moved = edges.join(step.select("a", F.col("p").alias("pa")), "a").join(step.select(F.col("a").alias("b"), F.col("p").alias("pb")), "b")
        edges = scratch.keep(moved.where("pa != pb").select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct(), "links")
        scratch.drop(*before)
    scratch.drop(edges)
    return labels
