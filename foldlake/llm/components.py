"""Connected components of an edge table by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import checkpointed, left_join_unique, narrowed


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b): label is the smallest node reachable.

    Each turn takes the smallest label among a node's neighbours and then the label of that
    label, so chains shorten by half; it stops when no label changes.  Rows are two ids wide;
    adaptive execution splits the side of a hub or of a large component's label.  Turns join by
    sort and merge, so no table of labels passes the driver.  An empty edge table gives an
    empty result; repeated edges and loops change nothing.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a is not null and b is not null").distinct()
    both = checkpointed(both)
    rows = both.count()
    both = narrowed(both, rows)
    labels = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label"))
    labels = checkpointed(narrowed(labels, rows))
    for _ in range(most):
        near = narrowed(both.join(labels.hint("merge"), both["b"] == labels["node"]), rows).groupBy("a").agg(F.min("label").alias("near"))
        low = labels.join(near.hint("merge"), labels["node"] == near["a"]).select("node", "label", F.least("label", "near").alias("low"))
        parent = labels.select(F.col("node").alias("p"), F.col("label").alias("up"))
        turned = narrowed(low, rows).join(parent.hint("merge"), low["low"] == parent["p"])
        turned = turned.select("node", F.least("low", "up").alias("label"), (F.least("low", "up") != F.col("label")).alias("moved"))
        turned = checkpointed(narrowed(turned, rows))
        labels = turned.select("node", "label")
        if not turned.where("moved").limit(1).count():
            return labels
    raise RuntimeError(f"no fixed point after {most} turns")


def merged(labels: DataFrame, edges: DataFrame, nodes: int) -> DataFrame:
    """(node, label) of the components ``labels`` (node, label) of at most ``nodes`` nodes after further ``edges`` (a, b).

    Each component is one node of the graph whose turns are taken, named by its label, so what
    was found before is not walked again.  Nodes of ``edges`` may be new.  Without edges, or
    with loops only, the labels stay.
    """
    ends = edges.select("a", "b")
    for end in "ab":
        own = labels.select(F.col("node").alias(end), F.col("label").alias(f"_{end}"))
        ends = ends.join(own, end, "left").withColumn(end, F.coalesce(f"_{end}", end)).drop(f"_{end}")
    roots = components(ends.where("a != b"))
    weights = labels.groupBy("label").agg(F.count("*").alias("weight"))
    roots = checkpointed(roots.select(F.col("node").alias("label"), F.col("label").alias("root")).join(weights, "label", "left"))
    moved = left_join_unique(labels, roots.where("weight is not null"), "label", "weight", nodes)
    new = roots.where("weight is null").select(F.col("label").alias("node"), F.col("root").alias("label"))
    return checkpointed(moved.select("node", F.coalesce("root", "label").alias("label")).unionByName(new))
