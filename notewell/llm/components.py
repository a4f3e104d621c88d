"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_scratch, materialize


def components(edges: DataFrame) -> DataFrame:
    """node and label (the least node of its component) for the nodes of edges (a, b).

    Each round takes the least label among neighbours, then the label's own label, so long chains halve. Every round is
    written to the shared folder; only its count of changes comes to the driver.
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).toDF("a", "b").distinct()
    both = materialize(both, "edges")
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        least = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("old"), F.least("label", "near").alias("mid"))
        jump = labels.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        moved = least.join(jump, F.col("mid") == F.col("_n"), "left").select("node", F.least("mid", F.coalesce("_l", "mid")).alias("label"), "old")
        moved = materialize(moved, "labels")
        changed = moved.filter("label != old").limit(1).count()
        drop_scratch(labels)
        labels = moved.select("node", "label")
        if not changed:
            drop_scratch(both)
            return labels
