"""Connected components of an edge table, by label propagation with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.shared import cut, hot_keys, join_hot, tidied


@tidied
def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b); label is the smallest node of its component.

    Each round takes the least label among the neighbours and then that label's own label, so that long chains
    close in few rounds. Labels and lineage stay in checkpointed tables; only counts reach the driver. A node with
    very many neighbours and a label that very many nodes share are joined by broadcast (``join_hot``)."""
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct())
    hubs = hot_keys(both, "b")
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("label")))
    while True:
        near = join_hot(both, labels.select(F.col("node").alias("b"), "label"), "b", hubs).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        nearest = cut(labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("via")))
        if not nearest.filter("via < old").count():
            return labels
        jump = labels.select(F.col("node").alias("via"), F.col("label").alias("far"))
        new = join_hot(nearest, jump, "via", hot_keys(nearest, "via"), "left")
        labels = cut(new.select("node", F.least("via", F.coalesce("far", "via")).alias("label")))
