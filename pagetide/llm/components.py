"""Connected components of an edge table, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetide.llm.shared import cut


def components(edges: DataFrame, most_rounds: int = 200) -> DataFrame:
    """(node, label) for each node of edges(a, b); label is the smallest node it can reach.

    Every round joins labels to edges, takes each node's smallest neighbouring label and then the
    label of that label. Nothing is gathered on the driver but one count a round.
    """
    flip = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")
    both = cut(edges.where("a <> b").select(flip).select("e.a", "e.b").distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")))
    for _ in range(most_rounds):
        near = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("l")), "b").groupBy(F.col("a").alias("node")).agg(F.min("l").alias("l"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "l").alias("label"))
        jump = step.join(labels.select(F.col("node").alias("label"), F.col("label").alias("far")), "label", "left").select("node", "old", F.least("label", "far").alias("label"))
        step = cut(jump)
        labels = step.select("node", "label")
        if not step.where("label <> old").head(1):
            return labels
    raise RuntimeError("components did not settle")
