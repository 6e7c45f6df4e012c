"""Exactly-once effect for at-least-once streams: usage facts and the audit log.

A micro-batch stores only stream ids that no committed batch has stored. It writes its rows to a
folder of its own, then a receipt of each id, and last its name to the commit list; readers see
committed batches only. So a batch that died half-way leaves nothing visible: its replay writes the
same folder again, and a job with a new checkpoint stores the rows anew, because receipts without a
commit do not count.

Receipts lie in buckets of neighbouring ids: ``partition-offset`` ids, as a topic gives them, by
partition and block of offsets, others by hash. A batch opens the buckets its own ids fall into and no
others, so what is read back follows the batch, not the table, also when the very first record comes
again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import audit as A
from ..operators import metering as M

_PARTS = ["month", "day"]
USAGE_SCHEMA = (
    "stream_id string, ts timestamp, tenant_id string, endpoint string, model string, "
    "tokens_in bigint, tokens_out bigint, cache_read int, cache_write int, cost_usd decimal(12,6), "
    "latency_ms bigint, cache_hit boolean, fallback boolean, status smallint, trace_id string, "
    "month string, day string"
)
AUDIT_SCHEMA = (
    "stream_id string, ts timestamp, actor string, action string, resource string, detail string, "
    "month string, day string"
)


def _dated(rows: DataFrame) -> DataFrame:
    return rows.withColumn("month", F.date_format("ts", "yyyy-MM")).withColumn(
        "day", F.date_format("ts", "yyyy-MM-dd")
    )


#: Ids of a bucket of receipts, where ids are numbers; buckets of other ids.
BLOCK_IDS, HASHED = 100_000, 256
_NUMBERED = r"^(?:(\d{1,9})-)?(\d{1,18})$"


def create_table(spark: SparkSession, path: str, schema: str) -> None:
    """An empty table, unless it exists."""
    empty = spark.createDataFrame([], f"{schema}, commit string")
    empty.write.mode("ignore").partitionBy("commit", *_PARTS).parquet(f"{path}/rows")
    spark.createDataFrame([], "commit string").write.mode("ignore").parquet(f"{path}/commits")


def _commits(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("commit string").parquet(f"{path}/commits")


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of committed batches."""
    rows = spark.read.schema(f"{schema}, commit string").parquet(f"{path}/rows")
    return rows.join(_commits(spark, path).distinct(), "commit", "left_semi").drop("commit")


def bucket_of(stream_id: Column) -> Column:
    """Bucket of an id's receipt: neighbouring ids of a topic's partition share one."""
    partition, number = F.regexp_extract(stream_id, _NUMBERED, 1), F.regexp_extract(stream_id, _NUMBERED, 2)
    block = F.floor(number.try_cast("bigint") / BLOCK_IDS).cast("string")
    hashed = F.pmod(F.xxhash64(stream_id), F.lit(HASHED)).cast("string")
    return F.when(number != "", F.concat(F.lit("n"), partition, F.lit("-"), block)).otherwise(F.concat(F.lit("h"), hashed))


def touched_receipts(rows: DataFrame, path: str) -> list[str]:
    """Folders of stored receipts that may hold an id of ``rows``: what a batch opens."""
    spark = rows.sparkSession
    # As many names as the batch touches blocks.
    names = [r.bucket for r in rows.select(bucket_of(F.col("stream_id")).alias("bucket")).distinct().collect()]
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/receipts")
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    folders = [f"{path}/receipts/bucket={n}" for n in sorted(names)]
    return [f for f in folders if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f))]


def append_once(rows: DataFrame, path: str, schema: str, commit: str) -> None:
    """Store the rows whose stream id no committed batch has, under the name ``commit``.

    The same name again replaces what a broken attempt left. There is no way to overwrite other batches.
    """
    spark, fresh = rows.sparkSession, rows
    folders = touched_receipts(rows, path)
    if folders:
        stored = spark.read.schema("stream_id string, bucket string, commit string").option("basePath", f"{path}/receipts").parquet(*folders)
        known = stored.where(F.col("commit") != commit).join(_commits(spark, path), "commit", "left_semi")
        fresh = rows.join(known.select("stream_id"), "stream_id", "left_anti")
    # Rebalancing makes as many files of a day as its size asks for.
    placed = _dated(fresh).hint("rebalance", *_PARTS).sortWithinPartitions(*_PARTS, "stream_id")
    placed.write.mode("overwrite").partitionBy(*_PARTS).parquet(f"{path}/rows/commit={commit}")
    written = spark.read.schema(schema).parquet(f"{path}/rows/commit={commit}").select("stream_id")
    receipts = written.select("stream_id", bucket_of(F.col("stream_id")).alias("bucket"), F.lit(commit).alias("commit"))
    receipts.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "bucket", "commit"
    ).parquet(f"{path}/receipts")
    spark.createDataFrame([(commit,)], "commit string").coalesce(1).write.mode("append").parquet(f"{path}/commits")


def run_name(batch: DataFrame) -> str:
    """The streaming query's id, which its checkpoint keeps; a name of its own for a batch stored by hand."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or f"direct-{uuid.uuid4().hex}"


def batch_folder(batch: DataFrame, path: str, batch_id: int) -> str:
    """Folder of one batch of one run. A replay writes the same folder again; a job that starts with a
    new checkpoint counts its batches from 0 but has another run, so nothing older is replaced."""
    run = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "direct"
    return f"{path}/run={run}/batch_id={batch_id}"


def _write_letters(letters: DataFrame, folder: str) -> None:
    letters.write.mode("overwrite").parquet(folder)


def usage_batch(facts: str, letters: str) -> Callable[[DataFrame, int], None]:
    """Sink function for usage records."""

    def store(batch: DataFrame, batch_id: int) -> None:
        parsed = M.read_usage(batch).persist()
        append_once(M.usage_facts(parsed), facts, USAGE_SCHEMA, f"{run_name(batch)}-{batch_id}")
        _write_letters(M.usage_dead_letters(parsed), batch_folder(batch, letters, batch_id))
        parsed.unpersist()

    return store


def audit_batch(log: str, letters: str) -> Callable[[DataFrame, int], None]:
    """Sink function for audit records."""

    def store(batch: DataFrame, batch_id: int) -> None:
        events = A.read_audit(batch).persist()
        append_once(A.audit_rows(events), log, AUDIT_SCHEMA, f"{run_name(batch)}-{batch_id}")
        _write_letters(A.audit_dead_letters(events), batch_folder(batch, letters, batch_id))
        events.unpersist()

    return store


def _run(records: DataFrame, sink, checkpoint: str, once: bool) -> StreamingQuery:
    writer = records.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def ingest_usage(records: DataFrame, facts: str, letters: str, checkpoint: str, once: bool = False):
    """Start storing a usage stream; ``once`` handles what is there and stops."""
    create_table(records.sparkSession, facts, USAGE_SCHEMA)
    return _run(records, usage_batch(facts, letters), checkpoint, once)


def ingest_audit(records: DataFrame, log: str, letters: str, checkpoint: str, once: bool = False):
    """Start storing an audit stream; ``once`` handles what is there and stops."""
    create_table(records.sparkSession, log, AUDIT_SCHEMA)
    return _run(records, audit_batch(log, letters), checkpoint, once)
