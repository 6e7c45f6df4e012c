"""Lineage over any number of hops: what a source reaches, and labels that travel along.

Both go in rounds that move only what is new, and each round is written, so a graph with cycles ends
and a lost executor costs a round. Rows meet on an edge's start; a node with very many edges is split
by the skew join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable


def reach(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, node, hops) of every node behind each of ``sources`` (source), over ``edges`` (src, dst).

    ``hops`` is the least number of edges. A source on a cycle reaches itself. The result has a row for
    each pair reached, so ask for the sources in question.
    """
    edges = durable(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct())
    fresh = durable(sources.select("source").distinct().join(edges, F.col("source") == F.col("src")).select("source", F.col("dst").alias("node")).distinct())
    found, hops = durable(fresh.withColumn("hops", F.lit(1))), 1
    while fresh.limit(1).count():
        hops += 1
        further = fresh.join(edges, F.col("node") == F.col("src")).select("source", F.col("dst").alias("node")).distinct()
        fresh = durable(further.join(found.select("source", "node"), ["source", "node"], "left_anti"))
        found = durable(found.unionByName(fresh.withColumn("hops", F.lit(hops))))
    return found


def raised_labels(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, level): the highest ``level`` of ``labels`` (node, level) on a node or anywhere before it.

    Rounds send on only the levels that rose, until none does. Nodes without any label have none.
    """
    edges = durable(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct())
    known = durable(labels.where("level IS NOT NULL").groupBy("node").agg(F.max("level").alias("level")))
    rose = known
    while rose.limit(1).count():
        sent = rose.join(edges, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.max("level").alias("sent"))
        both = durable(known.join(sent, "node", "full_outer"))
        rose = durable(both.where("level IS NULL OR sent > level").where("sent IS NOT NULL").select("node", F.col("sent").alias("level")))
        known = durable(both.select("node", F.greatest("level", "sent").alias("level")))
    return known
