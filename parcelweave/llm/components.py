"""Connected components of an edge table, by smallest label and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelweave.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``label`` (the smallest node of its component) for every end of ``a``-``b`` edges.

    Each round takes the smallest label among a node's neighbours and then that label's own label,
    so the number of rounds grows with the logarithm of a component's width, not with its size.
    Rounds are checkpointed to the shared folder; only the number of changes comes to the driver.
    Runs jobs when called. No edges give no rows.
    """
    both = cut_lineage(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels["node"] == near["a"]).select(
            "node", F.col("label").alias("before"), F.least("label", "near").alias("label")
        )
        lower = cut_lineage(lower)
        jump = lower.select(F.col("node").alias("at"), F.col("label").alias("further"))
        step = cut_lineage(
            lower.join(jump, lower["label"] == jump["at"]).select("node", "before", F.least("label", "further").alias("label"))
        )
        labels = step.select("node", "label")
        if step.filter("label <> before").limit(1).count() == 0:
            return labels
