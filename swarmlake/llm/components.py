"""Connected components of an edge list, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import drop, materialize


def components(edges: DataFrame) -> DataFrame:
    """node and label, the smallest node reachable, for every node of ``edges`` (a, b).

    Each round takes the smallest label of the neighbours, then the label's own
    label, so paths shorten by half and more. Only counts reach the driver.
    """
    both = edges.select(F.col("a").alias("src"), F.col("b").alias("dst"))
    both = materialize(both.unionByName(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "edges")
    labels = materialize(both.groupBy("src").agg(F.least(F.min("dst"), F.first("src")).alias("label")).select(F.col("src").alias("node"), "label"), "labels")
    while True:
        seen = both.join(labels, F.col("dst") == F.col("node")).groupBy("src").agg(F.min("label").alias("near"))
        hooked = materialize(labels.join(seen, F.col("node") == F.col("src")).select("node", "label", F.least("label", "near").alias("new")), "labels")
        parent = hooked.select(F.col("node").alias("parent"), F.col("new").alias("up"))
        jumped = hooked.join(parent, F.col("new") == F.col("parent"), "left")
        after = materialize(jumped.select("node", F.coalesce("up", "new").alias("label"), (F.coalesce("up", "new") != F.col("label")).alias("moved")), "labels")
        drop(labels)
        drop(hooked)
        labels = after.select("node", "label")
        if not after.filter("moved").limit(1).count():
            drop(both)
            return labels
