"""Connected components of links between rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every end of ``links`` (a, b): the smallest id that can be reached.

    Each round a row takes the least label beside it and then that label's own label, so rounds grow
    with the logarithm of a component's diameter. Labels are written every round, one row an id.
    """
    both = links.select("a", "b").where("a <> b")
    both = durable(both.union(both.select("b", "a")).distinct())
    labels = durable(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")))
    moved = True
    while moved:
        beside = both.join(labels.select(F.col("a").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("beside"))
        hop = labels.join(beside, "a").select("a", F.col("label").alias("old"), F.least("label", "beside").alias("label"))
        up = labels.select(F.col("a").alias("label"), F.col("label").alias("up"))
        labels = durable(hop.join(up, "label").select("a", "old", F.least("label", "up").alias("label")))
        moved = labels.where("old <> label").limit(1).count() > 0
        labels = labels.drop("old")
    return labels.select(F.col("a").alias("id"), F.col("label").alias("component"))
