"""Registry of the named queries and their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` computes the same rows independently."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: tidy(fn(spark, sf_dir))
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def tidy(df: DataFrame) -> DataFrame:
    """Plain types for comparison: whole numbers as bigint, decimals as double, times as text."""
    out = []
    for f in df.schema.fields:
        c, t = F.col(f"`{f.name}`"), f.dataType.simpleString()
        if t in ("tinyint", "smallint", "int"):
            c = c.cast("bigint")
        elif t.startswith("decimal") or t == "float":
            c = c.cast("double")
        elif t == "timestamp":
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif t == "date":
            c = c.cast("string")
        elif t == "array<string>":
            c = F.array_join(c, ",")
        out.append(c.alias(f.name))
    return df.select(*out)
