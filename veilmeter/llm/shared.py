"""Helpers of the operators: tables in the shared folder, id filters of bounded size, components."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir

#: A side of a join is broadcast up to this many rows of a few numbers each (tens of MB); beyond it
#: the join shuffles.
BROADCAST_ROWS = 1_000_000


def written(df: DataFrame, batch_rows: int | None = None) -> DataFrame:
    """``df`` written once to the cluster's shared folder and read back: survives lost executors.

    ``batch_rows`` bounds the Arrow batches of its Python steps while it is written.
    """
    spark, name = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    path = f"{shared_dir(spark).rstrip('/')}/llm/{uuid.uuid4().hex}"
    before = spark.conf.get(name)
    try:
        if batch_rows:
            spark.conf.set(name, str(batch_rows))
        df.write.parquet(path)
    finally:
        spark.conf.set(name, before)
    return spark.read.schema(df.schema).parquet(path)


def own(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns; others, whatever their names, play no part in an operator."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def one_row(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns behind a one-row ``inline``, so that no later step evaluates them again."""
    packed = F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()])))
    return df.select("*", packed)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (already written) marked for broadcast if it has at most ``rows`` rows."""
    return F.broadcast(df) if df.count() <= rows else df


class BitTable:
    """Set of places below ``2**bits``, as bits: asked with hashed values it has false positives, no
    false negatives. Spark builds it; the driver sees at most ``2**bits / 64`` numbers, whatever the
    input.
    """

    def __init__(self, places: DataFrame, bits: int) -> None:
        (name,) = places.columns
        bit = F.col(name).bitwiseAND(F.lit(63)).cast("int")
        words = (
            places.where(F.col(name).isNotNull())
            .groupBy(F.shiftright(F.col(name), 6).alias("at"))
            .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)).alias("word"))
            .toPandas()
        )
        table = np.zeros(1 << (bits - 6), np.int64)
        table[words["at"].to_numpy(np.int64)] = words["word"].to_numpy(np.int64)
        self.sent = places.sparkSession.sparkContext.broadcast(table)


def place_of(value: Column, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(value), 64 - bits)


def passes(table: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (table[place >> 6] >> (place & 63)) & 1 == 1


#: Bits of a word that a value of a MarkTable sets.
MARKS = 3


class MarkTable:
    """Set of evenly spread 64-bit values: the upper bits choose one of ``2**bits / 64`` words, the lower
    ones MARKS bits of it. Asked for another value it errs in under 4 % of cases up to one value for 8
    bits. As with BitTable, Spark builds it and the driver sees at most each word once.
    """

    def __init__(self, values: DataFrame, bits: int) -> None:
        (name,) = values.columns
        marks = F.lit(0).cast("bigint")
        for i in range(MARKS):
            bit = F.shiftright(name, 6 * i).bitwiseAND(F.lit(63)).cast("int")
            marks = marks.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit))
        words = values.groupBy(F.shiftrightunsigned(name, 70 - bits).alias("at")).agg(F.bit_or(marks).alias("word")).toArrow()
        table = np.zeros(1 << (bits - 6), np.uint64)
        table[words.column("at").to_numpy()] = words.column("word").to_numpy().view(np.uint64)
        self.sent = values.sparkSession.sparkContext.broadcast(table)


def marked_in(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of the values, as unsigned numbers, a MarkTable's words hold."""
    marks = np.zeros(len(values), np.uint64)
    for i in range(MARKS):
        marks |= np.uint64(1) << ((values >> np.uint64(6 * i)) & np.uint64(63))
    at = values >> np.uint64(64 - (len(table).bit_length() - 1))
    return table[at.astype(np.int64)] & marks == marks


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node of an edge.

    Each round a node takes the least label among its neighbours and then its label's label. Labels
    are written to the shared folder every round, so lineage stays short; rounds grow with the
    logarithm of a component's diameter, rows stay at one per node.
    """
    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x != y")
    both = written(both.union(both.select(F.col("y"), F.col("x"))).distinct())
    labels = written(both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("label")))
    while True:
        near = (
            both.join(labels.select(F.col("x").alias("y"), "label"), "y")
            .groupBy("x")
            .agg(F.min("label").alias("near"))
        )
        hop = labels.join(near, "x").select("x", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("x").alias("label"), F.col("label").alias("up"))
        labels = written(hop.join(up, "label").select("x", "old", F.least("label", "up").alias("label")))
        if not labels.where("old != label").limit(1).count():
            return labels.select(F.col("x").alias("node"), F.col("label").alias("component"))
        labels = labels.drop("old")

