"""File sources and exports: golden sets, CSV and JSON reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GOLDEN = (
    "id string, input string, metadata map<string,string>, expected string, "
    "must_cite array<string>, tags array<string>"
)


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """Golden questions, one JSON object per line."""
    return spark.read.schema(GOLDEN).json(path)


def export_path(root: str, name: str) -> str:
    """A new folder for one export."""
    return f"{root.rstrip('/')}/exports/{name}-{uuid.uuid4().hex}"


def export_csv(report: DataFrame, path: str) -> None:
    """Write a report as CSV; arrays become comma-separated text."""
    flat = [
        F.array_join(c, ",").alias(c) if t == "array<string>" else F.col(c) for c, t in report.dtypes
    ]
    report.select(*flat).write.option("header", True).option("escape", '"').csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)


def export_json(report: DataFrame, path: str) -> None:
    report.write.json(path)
