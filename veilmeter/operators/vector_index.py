"""Stored inverted-file index over vectors: rows by cell, cells by nearness, exact scores inside.

Cells are the centroids of a k-means over a bounded sample; every row is then written under its
nearest cell. A search asks for the nearest cells of each question only, so that the scan reads
their folders and no others, and scores what it reads exactly. Tenant, groups and quarantine are
checked before a row may be a candidate, as in ``retrieval.vector_branch``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import vectors
from .retrieval import CANDIDATES, readable, visible_chunks

#: Rows the cells are fitted on: those of the least hashes of their ids. Rounds of the k-means.
SAMPLE, ROUNDS = 20_000, 15
CELLS = 256
#: A search reads at least so many cells, and as many as hold REACH times the rows it wants.
PROBES, REACH = 8, 12


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm == 0, 1.0, norm)


def fit_cells(rows: DataFrame, cells: int = CELLS, sample: int = SAMPLE) -> np.ndarray:
    """Centroids of ``rows`` (id, vector): ``cells`` at most, fewer where the sample has fewer directions.

    The sample is at most ``sample`` rows, so what the driver holds does not grow with the table.
    """
    chosen = rows.where("vector IS NOT NULL").select("id", "vector", F.xxhash64("id").alias("_h")).orderBy("_h", "id").limit(sample)
    x = [r.vector for r in chosen.collect()]
    if not x:
        return np.zeros((0, 0))
    x = _unit(np.array(x, np.float64))
    start = np.unique(np.linspace(0, len(x) - 1, min(cells, len(x))).astype(int))
    c = x[start]
    for _ in range(ROUNDS):
        member = np.argmax(x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, member, x)
        # A cell that lost its members stays where it was.
        alive = np.bincount(member, minlength=len(c)) > 0
        c[alive] = _unit(sums[alive])
    return c


def _nearest(centroids: np.ndarray, many: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            # Every cell of a row is a row of its own where all are asked for.
            step = max(len(batch), 1) if many == 1 else 64
            for first in range(0, len(batch) if len(centroids) else 0, step):
                rows = batch.iloc[first : first + step]
                near = _unit(np.stack(rows["vector"].to_numpy()).astype(np.float64)) @ centroids.T
                if many == 1:
                    yield rows.assign(cell=np.argmax(near, axis=1).astype(np.int32))
                else:
                    out = rows.loc[rows.index.repeat(near.shape[1])]
                    yield out.assign(cell=np.tile(np.arange(near.shape[1], dtype=np.int32), len(rows)), near=near.ravel())

    return run


def _with_cells(rows: DataFrame, centroids: np.ndarray, many: int = 1) -> DataFrame:
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    schema += ", cell int" + (", near double" if many != 1 else "")
    return rows.mapInPandas(_nearest(centroids, many), schema)


def build(chunks: DataFrame, path: str, cells: int = CELLS, sample: int = SAMPLE) -> None:
    """Write the index of ``chunks`` (tenant_id, id, vector, acl_groups, quarantined) at ``path``.

    Every row with a vector is indexed, quarantined ones too, because quarantine may be lifted. A large
    cell has several files; within a file rows lie by tenant.
    """
    spark = chunks.sparkSession
    rows = chunks.select("tenant_id", "id", "vector", "acl_groups", "quarantined").where("vector IS NOT NULL")
    centroids = fit_cells(rows, cells, sample)
    named = [(i, c.tolist()) for i, c in enumerate(centroids)]
    spark.createDataFrame(named, "cell int, centre array<double>").coalesce(1).write.parquet(f"{path}/cells")
    placed = _with_cells(rows, centroids).hint("rebalance", "cell").sortWithinPartitions("cell", "tenant_id", "id")
    placed.write.partitionBy("cell").parquet(f"{path}/rows")
    # Even an empty index can say what its rows would look like.
    spark.createDataFrame([], placed.schema).coalesce(1).write.parquet(f"{path}/schema")
    sizes = visible_chunks(_rows(spark, path)).groupBy("tenant_id", "cell").agg(F.count(F.lit(1)).alias("n"))
    sizes.write.parquet(f"{path}/sizes")


def _rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(spark.read.parquet(f"{path}/schema").schema).parquet(f"{path}/rows")


def _sizes(spark: SparkSession, path: str) -> DataFrame:
    tenant = spark.read.parquet(f"{path}/schema").schema["tenant_id"].dataType.simpleString()
    return spark.read.schema(f"tenant_id {tenant}, cell int, n bigint").parquet(f"{path}/sizes")


def _centroids(spark: SparkSession, path: str) -> np.ndarray:
    rows = spark.read.schema("cell int, centre array<double>").parquet(f"{path}/cells").orderBy("cell").collect()
    return np.array([r.centre for r in rows])


def probed(spark: SparkSession, path: str, queries: DataFrame, k: int, probes: int | None, reach: int = REACH) -> DataFrame:
    """(tenant_id, id, vector, groups, cell): the cells each question reads; all of its tenant's without ``probes``."""
    asked = queries.select("tenant_id", "id", "vector", "groups")
    ranked = _with_cells(asked, _centroids(spark, path), many=0)
    ranked = ranked.join(_sizes(spark, path), ["tenant_id", "cell"])
    if probes is not None:
        w = Window.partitionBy("tenant_id", "id").orderBy(F.desc("near"), "cell")
        before = F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ranked = ranked.select("*", before.alias("_before"), F.row_number().over(w).alias("_nth"))
        ranked = ranked.where((F.col("_nth") <= probes) | (F.col("_before") < reach * k))
    return ranked.select("tenant_id", "id", "vector", "groups", "cell")


def search(
    spark: SparkSession, path: str, queries: DataFrame, k: int = CANDIDATES, probes: int | None = PROBES, reach: int = REACH
) -> DataFrame:
    """Best ``k`` chunks per question (tenant_id, id, vector, groups): query_id, chunk_id, score, rank.

    ``probes=None`` reads every cell of the question's tenant and is exact. Otherwise a chunk in a cell
    that was not read is missed; the cells read grow until they hold ``reach * k`` visible rows. Ties go
    to the smaller chunk id. Questions without a vector get no answer.
    """
    from ..session import durable

    asked = durable(probed(spark, path, queries.where("vector IS NOT NULL"), k, probes, reach))
    # A number for each cell at most: the scan lists only these folders.
    cells = [r.cell for r in asked.select("cell").distinct().collect()]
    rows = visible_chunks(_rows(spark, path)).where(F.col("cell").isin(cells))
    left = rows.select("tenant_id", "cell", "id", "vector", "acl_groups")
    found = vectors.best_partners(left, asked, ["tenant_id", "cell"], k, allowed=readable)
    w = Window.partitionBy("tenant_id", "right_id").orderBy(F.desc("score"), "left_id")
    return found.drop("rank").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(
        F.col("right_id").alias("query_id"), F.col("left_id").alias("chunk_id"), "score", "rank"
    )


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(queries, wanted, hits, recall) of ``found`` against the exact answers."""
    both = exact.select("query_id", "chunk_id").join(
        found.select("query_id", "chunk_id").withColumn("hit", F.lit(1)), ["query_id", "chunk_id"], "left"
    )
    return both.agg(
        F.countDistinct("query_id").alias("queries"), F.count(F.lit(1)).alias("wanted"), F.count("hit").alias("hits"),
        F.round(F.count("hit") / F.count(F.lit(1)), 6).alias("recall"),
    )
