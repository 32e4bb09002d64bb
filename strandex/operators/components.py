"""Distributed connected components by alternating stars, in DataFrame operations only.

A large-star step links every larger neighbour of a node to the smallest node of its neighbourhood, a small-star step does
so with the smaller neighbours and the node itself; edges only shrink to stars. When every node that hangs on another one hangs on exactly one
and nothing hangs on it, each node hangs on the smallest node of its component. The number of rounds grows with the logarithm of the longest path,
not with a group's size. Each step is written to the shared folder: that cuts the lineage, and it lets a join on a hot node be split, since
both of its sides come from shuffles of their own. What a step writes has at most twice as many rows as there are edges, so their number bounds its files:
each one costs an executor several processes where Hadoop's native library is missing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import counted, drop_stored, stored

TASK_ROWS = 100_000  # so few rows aren't spread over several files


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component (the smallest node reachable) for all nodes in edges (src, dst; any ordered type, not null).

    Self loops give a component of their own, edges may repeat and count in both directions; nodes without edges are unknown
    here. An empty table gives an empty one. More rounds than `rounds` are an error.
    """
    loops = edges.where("src = dst").select(F.col("src").alias("u"), F.col("dst").alias("v"))
    now, size = counted(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "edges", n=F.count("*"))
    for k in range(rounds + 1):
        files = -(-2 * size["n"] // TASK_ROWS) or 1
        both = now.select("u", "v", F.lit(1).alias("up")).union(now.select(F.col("v").alias("u"), F.col("u").alias("v"), F.lit(0)))
        lows = both.groupBy("u").agg(F.min("v").alias("m"), F.sum("up").alias("ups"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "ups", "n")
        low, open_ = counted(lows.coalesce(files), "low", nodes=F.count(F.when(F.col("ups") > 0, F.when(F.col("n") > 1, 1))))
        if not open_["nodes"]:
            drop_stored(low)
            break
        if k == rounds:
            raise RuntimeError(f"components: not done after {rounds} rounds")
        large = stored(both.join(low.select("u", "m"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct().coalesce(files), "large")
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")).coalesce(files), "least")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least)
        new, size = counted(small.distinct().coalesce(files), "edges", n=F.count("*"))
        drop_stored(now, low, large, least)
        now = new
    roots = now.select(F.col("v").alias("u"), "v")
    return now.union(roots).union(loops).groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.col("m").alias("component"))
