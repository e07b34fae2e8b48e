"""Connected components of a table of links, by repeated contraction on shuffled tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkrisk.functions.shared import Scratch


def components(links: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, component) for each node of ``links`` (a long, b long); a component is named by its smallest node.

    In each round every node hooks onto the smallest node next to it, twice, and links are contracted to the hooks; it ends
    when no link is left. Each round's tables are written to the shared folder and the round before is dropped, so lineage
    stays short and lost executors cost no earlier round. Only minima are gathered per node, never lists of neighbours.
    """
    scratch = scratch or Scratch(links.sparkSession, "components")
    both = links.select("a", "b").where("a <> b")
    edges = scratch.keep(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = scratch.keep(edges.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node")), "labels")
    while not edges.isEmpty():
        first = scratch.keep(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to")), "first")
        second = first.select(F.col("a").alias("to"), F.col("to").alias("next"))
        hooks = scratch.keep(first.join(second, "to", "left").select(F.col("a").alias("from"), F.coalesce("next", "to").alias("to")), "hooks")
        moved = labels.join(hooks, labels["component"] == hooks["from"], "left")
        new_labels = scratch.keep(moved.select("node", F.coalesce("to", "component").alias("component")), "labels")
        left, right = hooks.toDF("a", "a_to"), hooks.toDF("b", "b_to")
        left_over = edges.join(left, "a").join(right, "b").where("a_to <> b_to")
        new_edges = scratch.keep(left_over.select(F.col("a_to").alias("a"), F.col("b_to").alias("b")).distinct(), "edges")
        scratch.drop(labels, edges, first, hooks)
        labels, edges = new_labels, new_edges
    scratch.drop(edges)
    return labels
