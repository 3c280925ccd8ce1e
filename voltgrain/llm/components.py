"""Connected components of a link table, by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from voltgrain.llm.store import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is the smallest node reachable.

    Each round every root with a smaller neighbour hooks to its smallest one; pointers always fall,
    so they form a forest, which pointer jumping flattens in log(depth) steps; then edges are moved to
    the roots and edges inside a root vanish. Aggregates are plain minima (combined before the
    shuffle), so a node with very many links gathers nothing in one task. Ends when no edge is left;
    nothing is collected but counts. Null ends and self-links are ignored; no edges, no rows.
    """
    edges = scratch.save(edges.select("a", "b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    labels = scratch.save(nodes.withColumn("component", F.col("node")))
    while not edges.isEmpty():
        hook = scratch.save(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up")))
        while True:
            up = hook.select(F.col("node").alias("up"), F.col("up").alias("over"))
            jumped = scratch.save(hook.join(up, "up", "left").select("node", F.coalesce("over", "up").alias("up"), F.col("over").isNotNull().alias("moved")))
            done = jumped.where("moved").isEmpty()
            scratch.drop(hook)
            hook = jumped
            if done:
                break
        to = hook.select(F.col("node").alias("component"), "up")
        new_labels = scratch.save(labels.join(to, "component", "left").select("node", F.coalesce("up", "component").alias("component")))
        a, b = hook.select(F.col("node").alias("a"), F.col("up").alias("ua")), hook.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        moved = edges.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ua", "a").alias("a"), F.coalesce("ub", "b").alias("b")).where("a <> b")
        new_edges = scratch.save(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        scratch.drop(edges, labels, hook)
        edges, labels = new_edges, new_labels
    return labels
