"""Neighbours and simple numbers of a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.order import group_ranks
from ..sources.graphs import StringGraph

LISTED = 1024  # edges of a block of a node's list


def forward_edges(graph: StringGraph) -> DataFrame:
    return graph.edges.select("edge_id", "src", "dst")


def reverse_edges(graph: StringGraph) -> DataFrame:
    return graph.edges.select((F.col("edge_id") + 1).alias("edge_id"), F.col("dst").alias("src"), F.col("src").alias("dst"))


def edges_by_id(ids: DataFrame, graph: StringGraph) -> DataFrame:
    """edge_id, src, dst for ids (edge_id); odd ids are reverse edges."""
    forward = ids.select("edge_id", F.col("edge_id").bitwiseAND(F.lit(-2).cast("long")).alias("even")).join(graph.edges.select(F.col("edge_id").alias("even"), "src", "dst"), "even")
    odd = F.col("edge_id") % 2 == 1
    return forward.select("edge_id", F.when(odd, F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(odd, F.col("src")).otherwise(F.col("dst")).alias("dst"))


def _listed(edges: DataFrame, at: str, other: str, name: str) -> DataFrame:
    """One row per node, as the printed lists need it: blocks of LISTED edges are gathered first, then a node's blocks."""
    each = _ranked(edges, at, other).withColumn("block", F.expr(f"newest div {LISTED}"))
    blocks = each.groupBy("node_id", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("newest", "other"))), lambda x: x["other"]).alias("list"))
    return blocks.groupBy("node_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("block", "list"))), lambda x: x["list"])).alias(name))


def forward_from(graph: StringGraph) -> DataFrame:
    """node_id, successors (newest edge first)."""
    return _listed(graph.edges, "src", "dst", "successors")


def backward_from(graph: StringGraph) -> DataFrame:
    """node_id, predecessors (newest edge first)."""
    return _listed(graph.edges, "dst", "src", "predecessors")


def _ranked(edges: DataFrame, at: str, other: str) -> DataFrame:
    rows = edges.select(F.col(at).alias("node_id"), F.col(other).alias("other"), (-F.col("edge_id")).alias("age"))
    return group_ranks(rows, ["node_id"], ["age"], "newest").select("node_id", "other", "newest")


def neighbours(graph: StringGraph, forward: bool = True) -> DataFrame:
    """node_id, other, newest: one row for each edge, newest counting from 0 for a node's newest edge; a node with any number of edges is cut into
    ranges that are counted in tasks of their own."""
    return _ranked(graph.edges, *(("src", "dst") if forward else ("dst", "src")))


def forward_one(graph: StringGraph) -> DataFrame:
    """node_id, next: only nodes with exactly one outgoing edge."""
    return graph.edges.groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("n"), F.min("dst").alias("next")).where("n = 1").drop("n")


def graph_stats(graph: StringGraph) -> DataFrame:
    """num_nodes, num_edges (both directions) and num_locations."""
    e = graph.edges.agg((F.count("*") * 2).alias("num_edges"))
    return graph.nodes.agg(F.count("*").alias("num_nodes"), F.coalesce(F.sum("len"), F.lit(0)).cast("long").alias("num_locations")).join(F.broadcast(e))


def adjacency_dump(graph: StringGraph) -> DataFrame:
    """node_id, seg_id, forward and backward neighbours as text, newest edge first."""
    text = lambda c: F.coalesce(F.array_join(F.transform(c, lambda x: x.cast("string")), ","), F.lit(""))
    n = graph.nodes.select("node_id", "seg_id").join(forward_from(graph), "node_id", "left").join(backward_from(graph), "node_id", "left")
    return n.select("node_id", "seg_id", text(F.col("successors")).alias("forward"), text(F.col("predecessors")).alias("backward"))
