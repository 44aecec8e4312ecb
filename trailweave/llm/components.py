"""Connected components of an edge table, in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailweave.llm.common import materialise


def components(edges: DataFrame) -> DataFrame:
    """node, label for every node of ``edges(a, b)``: the label is the smallest node of its
    component. Each round takes the least label among neighbours, then the label's label, so
    stars take two rounds and chains a logarithmic number. Every round is a written table;
    neither edges nor labels come to the driver, only the count of labels that changed."""
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a")).distinct()
    both = materialise(both, "edges")
    labels = materialise(both.groupBy("node").agg(F.least(F.min("other"), F.min("node")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("label").alias("far"))
        new = materialise(step.join(jump, "to").select("node", F.least("to", "far").alias("label"), (F.least("to", "far") < F.col("old")).alias("changed")), "labels")
        labels = new.select("node", "label")
        if not new.where("changed").limit(1).count():
            return labels
