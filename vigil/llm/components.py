"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import materialise


def components(links: DataFrame) -> DataFrame:
    """``node, label`` for every node of the links (a, b): the label is the
    smallest node reachable.

    Each round takes the smallest label among a node and its neighbours and
    then the label of that label, until nothing changes; rounds grow with the
    logarithm of the longest shortest path. Both joins are against written
    tables that hold a node once, so Spark can split a node with many links.
    """
    links = materialise(links.select("a", "b"), "cc-links")
    # The first round's labels: the smallest neighbour, or the node itself.
    ends = (links.select(F.col("a").alias("node"), F.least("a", "b").alias("label"))
            .unionByName(links.select(F.col("b").alias("node"), F.least("a", "b").alias("label"))))
    labels = materialise(ends.groupBy("node").agg(F.min("label").alias("label")), "cc-labels")
    while True:
        near_a = links.join(labels, links["a"] == labels["node"]).select(F.col("b").alias("node"), "label")
        near_b = links.join(labels, links["b"] == labels["node"]).select(F.col("a").alias("node"), "label")
        best = materialise(near_a.unionByName(near_b).groupBy("node").agg(F.min("label").alias("m")), "cc-best")
        low = materialise(labels.join(best, "node").select(
            "node", F.col("label").alias("old"), F.least("label", "m").alias("low")), "cc-low")
        up = low.select(F.col("node").alias("low"), F.col("low").alias("up"))
        moved = materialise(low.join(up, "low").select(
            "node", "old", F.least("low", "up").alias("label")), "cc-moved")
        labels = moved.select("node", "label")
        if moved.filter(F.col("old") != F.col("label")).isEmpty():
            return labels
