"""Letters since the last start, modulo n, carried through merges.

A node's tag says how many letters before its first one the last start lies, less one, in 0 ... n - 1; n - 1 makes its own first letter a start. Each predecessor brings (its tag + its letters) mod n,
and the largest of these counts. On an edge that is a function from 0 ... n - 1 to itself, held as an array. Functions along a chain are composed and those of parallel edges joined by
their maximum, so nodes with one predecessor can leave the graph, many at once (see paths); chains, bubbles and all that hangs on sources fold up in a number of rounds that grows with the logarithm.
What is left takes a round of joins for each level.

Back edges (see strong) are left out. Where one ends, the walk starts anew.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.storage import counted, drop_stored, stored
from ..sources.graphs import StringGraph
from .paths import VIRTUAL
from .strong import back_edges, strong_components


def _joined(rows: DataFrame, n: int) -> DataFrame:
    """One edge between two nodes, by the largest value at each place."""
    return rows.groupBy("src", "dst").agg(F.array(*(F.max(F.col("f")[i]) for i in range(n))).alias("f"))


def _after(f: Column, g: Column) -> Column:
    """First f, then g."""
    return F.transform(f, lambda t: g[t])


def start_tags(graph: StringGraph, n: int) -> DataFrame:
    """node_id, tag for every node; sources, targets of back edges and nodes on nothing but such have n - 1."""
    back = stored(back_edges(graph, stored(strong_components(graph), "strong")), "back")
    size = graph.nodes.select(F.col("node_id").alias("src"), (F.col("len") % n).cast("int").alias("size"))
    anew = back.select("dst").distinct()
    kept = graph.edges.select("src", "dst").distinct().join(anew, "dst", "left_anti").join(size, "src")
    step = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda t: ((t + F.col("size")) % n).cast("int"))
    known = kept.select("dst").distinct()
    first = graph.nodes.select(F.col("node_id").alias("dst")).join(known, "dst", "left_anti").select(F.lit(VIRTUAL).alias("src"), "dst", F.array_repeat(F.lit(n - 1).cast("int"), n).alias("f"))
    now, left = stored(kept.select("src", "dst", step.alias("f")).union(first), "tags"), []
    for k in count():
        one = now.groupBy("dst").agg(F.count("*").alias("c"), F.min("src").alias("src")).where("c = 1").select(F.col("dst").alias("node"), "src", F.xxhash64("dst", F.lit(k)).alias("h"))
        # Of a node and its predecessor that could both leave, the one with the larger hash stays.
        tied = one.join(one.select(F.col("node").alias("src"), F.col("h").alias("h2")), "src").select(F.when(F.struct("h", "node") > F.struct("h2", "src"), F.col("node")).otherwise(F.col("src")).alias("node")).distinct()
        goes, found = counted(one.join(tied, "node", "left_anti").select("node"), "tags-goes", n=F.count("*"))
        if not found["n"]:
            drop_stored(goes)
            break
        into = now.join(goes.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("dst").alias("node"), "src", "f")
        made = now.join(into.select(F.col("node").alias("src"), F.col("src").alias("before"), F.col("f").alias("f1")), "src").select(F.col("before").alias("src"), "dst", _after(F.col("f1"), F.col("f")).alias("f"))
        rest = now.join(goes.select(F.col("node").alias("src")), "src", "left_anti").join(goes.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst", "f")
        left.append(into)
        now = stored(_joined(rest.union(made), n), "tags")
    # All but what is reached from nodes with several predecessors is gone; a level each from here.
    values = front = stored(graph.nodes.sparkSession.range(1).select(F.lit(VIRTUAL).alias("node"), F.lit(n - 1).cast("int").alias("tag")), "tags-known")
    open_, waiting = now, stored(now.select(F.col("dst").alias("node"), F.lit(0).cast("int").alias("tag")).distinct(), "tags-waiting")
    while True:
        brings = open_.join(front.select(F.col("node").alias("src"), "tag"), "src").groupBy(F.col("dst").alias("node")).agg(F.max(F.col("f")[F.col("tag")]).alias("t"))
        waiting = stored(waiting.join(brings, "node", "left").select("node", F.greatest("tag", "t").alias("tag")), "tags-waiting")
        open_ = stored(open_.join(front.select(F.col("node").alias("src")), "src", "left_anti"), "tags")
        front, ready = counted(waiting.join(open_.select(F.col("dst").alias("node")), "node", "left_anti"), "tags-known", n=F.count("*"))
        if not ready["n"]:
            break
        waiting = stored(waiting.join(front.select("node"), "node", "left_anti"), "tags-waiting")
        values = stored(values.union(front), "tags-known")
    for k, into in enumerate(reversed(left), 1):
        values = values.union(into.join(values.select(F.col("node").alias("src"), "tag"), "src").select("node", F.col("f")[F.col("tag")].alias("tag")))
        values = stored(values, "tags-known") if k % 4 == 0 else values  # so that a round reads few tables
    return values.where(F.col("node") != VIRTUAL).select(F.col("node").alias("node_id"), "tag")
