"""Connected components by label spreading with pointer jumping, on tables only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.llm.scratch import discard, written


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of the edges (a, b) is connected with.

    Nodes without an edge don't occur. In each round every node takes the
    smallest label among its neighbours and then the label of its label, so
    the number of rounds is about the logarithm of the longest path. Every
    round is written to the shared folder; nothing but two counts gets to the
    driver.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = written(both, "component-edges")
    labels = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"), "component-labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", "label", F.least("label", "near").alias("next"))
        lower = written(lower, "component-step")
        jump = lower.select(F.col("node").alias("next"), F.col("next").alias("far"))
        after = written(lower.join(jump, "next", "left").select("node", F.least("next", "far").alias("label"), (F.least("next", "far") < F.col("label")).alias("moved")), "component-labels")
        moved = after.where("moved").limit(1).count()
        discard(labels)
        discard(lower)
        labels = after.select("node", "label")
        if not moved:
            discard(both)
            return labels.withColumnRenamed("label", "component")
