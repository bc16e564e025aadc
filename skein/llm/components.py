"""Connected components of an edge table by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, label``: the least node reachable from every node that has an edge.

    Each round takes the least label among the neighbours (aggregated before the shuffle, so a hub costs no
    more than others) and then that label's own label; the tables of a round are written, not held.
    """
    spark = edges.sparkSession
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("other")).where("node != other")
    both = staged(both.unionByName(both.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct(), "cc-edges")
    labels = staged(both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("label")), "cc-labels")
    while True:
        # Only what is not yet at rest moves: neighbours' labels, then the label of the label.
        heard = both.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("heard"))
        near = labels.join(heard, "node").select("node", "label", F.least("label", "heard").alias("new"))
        jump = labels.select(F.col("node").alias("new"), F.col("label").alias("far"))
        moved = staged(near.join(jump, "new", "left").select("node", "label", F.least("new", F.coalesce("far", "new")).alias("new")), "cc-round")
        changed = moved.where("new != label").limit(1).count()
        labels = moved.select("node", F.col("new").alias("label"))
        if not changed:
            return labels
