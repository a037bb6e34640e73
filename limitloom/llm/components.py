"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limitloom.llm.frames import durable


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) with the smallest node of its component, for every node of an edge.

    Each round takes the smallest label around a node and then the label of that label, so the
    number of rounds follows the logarithm of the longest chain. Rounds are stored tables.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b"))
    both = durable(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = durable(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        around = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("m"))
        least = labels.join(around, labels.node == around.a).select("node", F.col("label").alias("was"), F.least("label", "m").alias("label"))
        above = labels.select(F.col("node").alias("label"), F.col("label").alias("top"))
        labels_now = durable(least.join(above, "label", "left").select("node", "was", F.least("label", "top").alias("label")), "labels")
        if not labels_now.filter("label <> was").limit(1).count():
            return labels_now.select("node", "label")
        labels = labels_now.select("node", "label")
