"""Connected components of a graph given by its edges, as a loop of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnfield.llm.common import written


def connected(edges: DataFrame) -> DataFrame:
    """(v, label) of each node of ``edges`` (a, b): the smallest node that it is linked to.

    Each round takes the smallest label among a node and its neighbours and then that label's
    own label, so the rounds grow with the logarithm of a component's diameter. Each round's
    labels are a table in the shared folder: plans stay short, and lost executors cost little.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("b")).select("v", F.least("v", "b").alias("label")), "labels")
    while True:
        near = labels.select(F.col("v").alias("b"), F.col("label").alias("m"))
        least = both.join(near, "b").groupBy(F.col("a").alias("v")).agg(F.min("m").alias("m"))
        lower = written(labels.join(least, "v").select("v", F.least("label", "m").alias("label")), "labels")
        above = lower.select(F.col("v").alias("label"), F.col("label").alias("top"))
        after = written(lower.join(above, "label").select("v", F.col("top").alias("label")), "labels")
        total = F.sum(F.col("label").cast("decimal(38,0)"))
        if labels.agg(total).first() == after.agg(total).first():  # labels only fall
            return after
        labels = after
