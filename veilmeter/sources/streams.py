"""Streaming sources of string records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import STREAM_RECORD


def record_files(
    spark: SparkSession, path: str, schema: str = STREAM_RECORD, files_per_batch: int | None = None
) -> DataFrame:
    """Records arriving as Parquet files; the checkpoint remembers what was read."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def record_topic(spark: SparkSession, servers: str, topic: str, per_batch: int = 1_000_000) -> DataFrame:
    """Records from a Kafka topic whose values are flat JSON objects.

    The stream id is the record's partition and offset, so a redelivered record keeps its id.
    Needs the Kafka connector on the class path.
    """
    raw = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
        .option("maxOffsetsPerTrigger", per_batch)
        .load()
    )
    return raw.select(
        F.concat_ws("-", "partition", "offset").alias("stream_id"),
        F.from_json(F.col("value").cast("string"), "map<string,string>").alias("fields"),
    )
