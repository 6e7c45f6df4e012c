"""The operators applied to their whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chats import CHATS_SQL, chats
from .decontamination import leaks
from .divergence import DIVERGENCE_SQL, divergences
from .filters import FILTERS_SQL, filter_orders
from .language import languages
from .licences import LICENCES_SQL, licences
from .mixing import rates
from .near_copies import near_copies
from .pages import PAGES_SQL, articles
from .quality import QUALITY_SQL, quality
from .secrets import SECRETS_SQL, secrets
from .sharding import SHARDING_SQL, shard
from .suffixes import REPEATS_SQL, repeats

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


@query("op1_benchmark_leaks")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op4_line_quality", QUALITY_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents")).drop("clean_text")


@query("op7_near_copies")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents"))


@query("op9_secret_scan", SECRETS_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents")).drop("found")


@query("op8_maximal_chats", CHATS_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chats(table(spark, sf_dir, "conversations"))


@query("op2_shard_placement", SHARDING_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents").select("doc_id"))


@query("op3_licence_rules", LICENCES_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences(table(spark, sf_dir, "documents"))


@query("op10_languages")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(table(spark, sf_dir, "documents"))


@query("op5_page_articles", PAGES_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles(table(spark, sf_dir, "pages"))


@query("op6_mixing_rates")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op13_filter_orders", FILTERS_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_orders(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op11_source_divergence", DIVERGENCE_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergences(table(spark, sf_dir, "documents"))


@query("op12_repeated_text", REPEATS_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents")).drop("begins", "ends")
