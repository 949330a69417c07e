"""Connected components of an edge table, by hooking every node to its smallest neighbour, jumping to the roots and contracting."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .shared import discard, settle


def to_roots(label: DataFrame) -> DataFrame:
    """(node, root) with every node's last label of a chain, from a settled table of nodes and their labels.

    Each pass replaces a label by the label's own, so a chain of n nodes takes the logarithm of n passes; a star takes one."""
    while True:
        step = label.select(F.col("node").alias("root"), F.col("root").alias("next"))
        jumped = label.select("node", "root").join(step, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved"))
        before, label = label, settle(jumped, "labels")
        discard(before)
        if label.where("moved").isEmpty():
            return label


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in edges (a, b), where root is the smallest node reachable.

    A round gives each node the smallest of itself and its neighbours as label, follows labels to their ends, and keeps the edges
    between different ends.  However a chain is numbered it is gone after few rounds: one in ascending order after one, as
    labels are followed in logarithmically many passes.  Every round is a written table, the tables that it was made of are
    deleted, and nothing but one row that says whether something is left comes to the driver."""
    edges = settle(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    mapping = None
    while True:
        near = edges.select(F.col("a").alias("node"), F.col("b").alias("near")).union(edges.select("b", "a"))
        label = to_roots(settle(near.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("root")), "labels"))
        before, mapping = mapping, label
        if before is not None:
            step = label.select(F.col("node").alias("root"), F.col("root").alias("next"))
            mapping = settle(before.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "roots")
        left, right = label.select(F.col("node").alias("a"), F.col("root").alias("x")), label.select(F.col("node").alias("b"), F.col("root").alias("y"))
        between = edges.join(left, "a").join(right, "b").where("x <> y")
        between = settle(between.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        discard(edges, before, None if mapping is label else label)
        edges = between
        if edges.isEmpty():
            discard(edges)
            return mapping.select("node", "root")
