"""Connected components of an edge table by label propagation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the undirected edges ``a, b``: label is
    the component's smallest node.

    Labels go to neighbours and are then replaced by their own label, which
    halves chains; every round is written to the shared folder, so that a lost
    executor costs one round at most.  Messages to a node are combined before
    the shuffle."""
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")), "labels")
    while True:
        sent = both.join(labels, both.a == labels.node).groupBy(F.col("b").alias("node")).agg(F.min("label").alias("sent"))
        lower = labels.join(sent, "node").select("node", F.col("label").alias("old"), F.least("label", "sent").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        after = materialize(lower.join(jump, "label", "left").select("node", "old", F.coalesce("far", "label").alias("label")), "labels")
        labels = after.select("node", "label")
        if after.where(F.col("label") != F.col("old")).isEmpty():
            return labels
