"""Strongly connected components, and an order of the nodes that only edges inside components can run against.

Contraction comes first (see paths): what leaves the graph, in-degree times out-degree not being more than its edges, keeps who reaches whom among the rest, so trees, chains and bubbles of
any length go in a number of rounds that grows with the logarithm. In the dense core that is left, every node takes the smallest id that reaches it
(forward colouring); nodes that reach back to the node whose id they carry are its component (backward check) and leave the core. A node that left before belongs to a component if one
of its predecessors and one of its successors do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.order import ranks
from ..functions.storage import counted, drop_stored, stored
from ..sources.graphs import StringGraph
from .paths import contracted, order_levels


def _coloured(edges: DataFrame) -> DataFrame:
    """node, c: the smallest id of all nodes that reach it, itself included; edges (src, dst)."""
    colour = front = stored(edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("c", F.col("node")), "colours")
    while True:
        step = edges.join(front.withColumnRenamed("node", "src"), "src").groupBy("dst").agg(F.min("c").alias("better"))
        front, size = counted(step.join(colour, step["dst"] == colour["node"]).where("better < c").select("node", F.col("better").alias("c")), "colours", n=F.count("*"))
        if not size["n"]:
            return colour
        new = stored(colour.join(front.withColumnRenamed("c", "better"), "node", "left").select("node", F.coalesce("better", "c").alias("c")), "colours")
        drop_stored(colour)
        colour = new


def _core_components(edges: DataFrame) -> DataFrame | None:
    """node, c: components of more than one node in edges (src, dst); None if there are none."""
    found, now = [], stored(edges.select("src", "dst"), "core")
    while True:
        colour = _coloured(now)
        inner = now.join(colour.toDF("src", "c"), "src").join(colour.toDF("dst", "c2"), "dst").where("c = c2").select("src", "dst", "c")
        inner, size = counted(inner, "core", n=F.count("*"))
        if not size["n"]:
            break
        # Backward from the nodes that carry their own id.
        reached = front = stored(colour.where("node = c"), "core-reached")
        while True:
            step = inner.join(front.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node"), "c").distinct()
            front, more = counted(step.join(reached, "node", "left_anti"), "core-reached", n=F.count("*"))
            if not more["n"]:
                break
            reached = stored(reached.union(front), "core-reached")
        found.append(reached)
        rest = now.join(reached.select(F.col("node").alias("src")), "src", "left_anti").join(reached.select(F.col("node").alias("dst")), "dst", "left_anti")
        now, left = counted(rest, "core", n=F.count("*"))
        if not left["n"]:
            break
    out = None
    for f in found:
        out = f if out is None else out.union(f)
    return out


def _labelled(rows: DataFrame, side: str, known: DataFrame | None) -> DataFrame:
    """rows (node, side) with c: the component of the neighbour in side; a neighbour in none stands for one of its own."""
    if known is None:
        return rows.select("node", side, F.col(side).alias("c"))
    at = rows.join(known.select(F.col("node").alias(side), "c"), side, "left")
    return at.select("node", side, F.coalesce("c", side).alias("c"))


def strong_components(graph: StringGraph) -> DataFrame:
    """node_id, component: the smallest node that it reaches and that reaches it (itself, where there is no other)."""
    plain = graph.edges.select("src", "dst").distinct()
    c = contracted(plain.select("src", "dst", F.lit(1).cast("long").alias("w")))
    known = _core_components(c.core)
    for into, on in zip(reversed(c.left), reversed(c.onward)):
        # A predecessor and a successor in one component, or one neighbour that is both.
        both = _labelled(into, "src", known).join(_labelled(on, "dst", known).select("node", "c"), ["node", "c"])
        members, size = counted(both.select("node", "c").distinct(), "strong", n=F.count("*"))
        if size["n"]:
            new = members.union(members.select(F.col("c").alias("node"), "c"))  # a neighbour that stood for itself is a member too
            known = stored((new if known is None else known.union(new)).distinct(), "strong")
        else:
            drop_stored(members)
    if known is None:
        return graph.nodes.select("node_id", F.col("node_id").alias("component"))
    low = known.groupBy("c").agg(F.min("node").alias("component"))
    named = known.join(low, "c").select(F.col("node").alias("node_id"), "component")
    return graph.nodes.select("node_id").join(named, "node_id", "left").select("node_id", F.coalesce("component", "node_id").alias("component"))


def top_order(graph: StringGraph, components: DataFrame | None = None) -> DataFrame:
    """node_id, component, level, place.

    level is the number of edges on the longest way between components that ends in the node's own: edges between components go to a higher one, nodes of a component share it. place (0, 1, ...)
    counts nodes by level, component and id; an edge goes to a higher place unless it is a back edge.
    """
    strong = components if components is not None else stored(strong_components(graph), "strong")
    label = lambda side: strong.select(F.col("node_id").alias(side), F.col("component").alias(f"{side}_c"))
    between = graph.edges.select("src", "dst").join(label("src"), "src").join(label("dst"), "dst").where("src_c <> dst_c").select(F.col("src_c").alias("src"), F.col("dst_c").alias("dst")).distinct()
    condensed = StringGraph(strong.select(F.col("component").alias("node_id")).distinct(), stored(between, "condensed"))
    level = order_levels(condensed)
    rows = strong.join(level.withColumnRenamed("node_id", "component"), "component").select("node_id", "component", "level")
    return ranks(rows, "level", "component", "node_id", name="place")


def back_edges(graph: StringGraph, order: DataFrame) -> DataFrame:
    """edge_id, src, dst: the edges inside a component that don't go to a larger id (self loops too). Every cycle has one, and without them an order is one of a graph without cycles."""
    at = order.select("node_id", "component")
    e = graph.edges.join(at.toDF("src", "a"), "src").join(at.toDF("dst", "b"), "dst")
    return e.where("a = b and dst <= src").select("edge_id", "src", "dst")
