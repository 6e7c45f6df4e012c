"""Documents to shards: quality rules, near copies, benchmark passages, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last
return the columns of documents; the last adds slot and shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilmeter.llm.decontamination import without_leaks
from veilmeter.llm.mixing import mixed
from veilmeter.llm.near_copies import one_of_each
from veilmeter.llm.quality import cleaned
from veilmeter.llm.shared import written
from veilmeter.llm.sharding import shard


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without rejected documents and without the failing lines of the others."""
    return cleaned(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold a benchmark passage."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As often as the fitted rates say, no document twice."""
    return mixed(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), most=1.0)


def place(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With the shard of each document."""
    return shard(docs)


STAGES = [
    ("quality", clean),
    ("near_copies", deduplicate),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("sharding", place),
]
#: Sketches, fitted memberships and rates have no SQL form; the tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
