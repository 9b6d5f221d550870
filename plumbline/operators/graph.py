"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import discard, materialize


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for every node on an edge.

    ``edges`` has long columns a, b. Each round hangs the larger neighbours of
    a node, then the node itself, on the smallest node known; rounds grow with
    the logarithm of a component's diameter and end once every edge hangs on
    the smallest node of its component. Every round is a written table, so a
    lost executor costs no more than the round in hand. Both sides of a join
    grow with the edges and are merged: none is sent through the driver. A
    hub's rows are joined on the hub, where adaptive execution splits a skewed
    side.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    before = []
    for _ in range(rounds):
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        lows = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(lows.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lows = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lows.hint("merge"), "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        edges = materialize(small.union(lows.select("u", "m")).distinct(), "edges")
        discard(*before)
        before = [edges]
        # stars: a node that hangs on another does so once, and nothing hangs on it
        ends = edges.select(F.col("a").alias("u"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
        if ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up = 1 AND down = 1)").isEmpty():
            found = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
            return found.union(found.select("component", "component").distinct())
    raise RuntimeError("components did not settle")
