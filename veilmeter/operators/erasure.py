"""Erasure and retention in stored tables: copy on write of the files that hold the rows.

A run first lists the files that hold rows to erase, writes what is left of them to a staging folder
and notes in a manifest which files go and which come. Then it moves the new files in and removes the
old ones; files without such rows are not touched and keep their names. The manifest makes a broken
run resumable: every move and removal is done only if it is still due, so starting again with the
same run folder ends where an undisturbed run ends. Afterwards the table is read again; rows still
found there (written meanwhile, say) are erased in another pass, at most ``TRIES`` in all, and what
remains then is escalated.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.crypto import sha256

TRIES = 3
MANIFEST = "store string, old string, new string"


@dataclass(frozen=True)
class Store:
    """A Parquet table partitioned by ``partitions`` whose rows are found by ``location``. Rows are
    deleted, or only lose the columns ``blank``."""

    name: str
    path: str
    schema: str
    location: str
    partitions: Sequence[str] = ()
    blank: Sequence[str] = ()

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.schema).parquet(self.path)


def targets(plan: DataFrame) -> DataFrame:
    """(store, location, held) from an erasure plan: a row that any hold covers is held."""
    held = F.bool_or(F.col("action") == "restrict").alias("held")
    return plan.where("action <> 'manual'").groupBy("store", "location").agg(held)


def _due(store: Store) -> Column:
    """Of a located row: whether there is something left to erase."""
    if not store.blank:
        return F.lit(True)
    some = F.lit(False)
    for c in store.blank:
        some = some | F.col(c).isNotNull()
    return some


def _located(spark: SparkSession, store: Store, wanted: DataFrame) -> DataFrame:
    """The store's rows with ``_held``: NULL for a row nobody asked for."""
    asked = wanted.where(F.col("store") == store.name).select(F.col("location").alias("_location"), F.col("held").alias("_held"))
    rows = store.read(spark).select("*", F.col("_metadata.file_path").alias("_file"))
    return rows.join(asked, F.col(store.location) == F.col("_location"), "left").drop("_location")


class _Files:
    """The file system of a path, on the driver: it moves and removes files, it reads none."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.at = spark._jvm.org.apache.hadoop.fs.Path
        self.system = self.at(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self.system.exists(self.at(path))

    def move(self, source: str, to: str) -> None:
        self.system.mkdirs(self.at(to).getParent())
        if not self.system.rename(self.at(source), self.at(to)):
            raise OSError(f"cannot move {source}")

    def remove(self, path: str) -> None:
        self.system.delete(self.at(path), False)


def _stage(spark: SparkSession, store: Store, wanted: DataFrame, folder: str) -> None:
    """Write what is left of the files that hold rows to erase, and the manifest, which is complete or absent."""
    rows = _located(spark, store, wanted)
    gone = F.coalesce(~F.col("_held"), F.lit(False)) & _due(store)
    files = rows.where(gone).select("_file").distinct()
    files.write.mode("overwrite").parquet(f"{folder}/files")
    touched = rows.join(spark.read.schema("_file string").parquet(f"{folder}/files"), "_file", "left_semi").withColumn("_gone", gone)
    if store.blank:
        kept = touched.withColumns({c: F.when(~F.col("_gone"), F.col(c)) for c in store.blank})
    else:
        kept = touched.where(~F.col("_gone"))
    kept = kept.drop("_held", "_file", "_gone")
    placed = kept.hint("rebalance", *store.partitions) if store.partitions else kept.hint("rebalance")
    placed.write.mode("overwrite").partitionBy(*store.partitions).parquet(f"{folder}/staged")
    new = spark.read.schema(store.schema).parquet(f"{folder}/staged").select(F.col("_metadata.file_path").alias("new")).distinct()
    old = spark.read.schema("_file string").parquet(f"{folder}/files").select(F.col("_file").alias("old"))
    both = old.select("old", F.lit(None).cast("string").alias("new")).unionByName(new.select(F.lit(None).cast("string").alias("old"), "new"))
    both.select(F.lit(store.name).alias("store"), "old", "new").write.mode("overwrite").parquet(f"{folder}/manifest")


def _swap(spark: SparkSession, store: Store, folder: str) -> None:
    """Do what the manifest says and is not done yet."""
    files = _Files(spark, store.path)
    staged = f"{folder}/staged/".split(":", 1)[-1].lstrip("/")
    # As many lines as files were rewritten.
    lines = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").collect()
    new, old = ([unquote(line[i]) for line in lines if line[i] is not None] for i in ("new", "old"))
    for name in new:
        if files.exists(name):
            files.move(name, f"{store.path}/{name.split(staged, 1)[1]}")
    for name in old:
        if files.exists(name):
            files.remove(name)


def _left(spark: SparkSession, store: Store, wanted: DataFrame) -> tuple[int, int, int, str]:
    """Held and remaining rows, all rows, and a digest of all rows, of the table as it is now."""
    rows = _located(spark, store, wanted)
    columns = [c.split()[0] for c in store.schema.split(", ")]
    r = rows.agg(
        F.count_if(F.col("_held")).alias("held"), F.count_if(~F.col("_held") & _due(store)).alias("remaining"),
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*columns)).alias("content"),
    ).first()
    return r.held, r.remaining, r.n, str(r.content)


def erase_stored(spark: SparkSession, stores: Sequence[Store], wanted: DataFrame, folder: str, tries: int = TRIES) -> DataFrame:
    """Erase ``wanted`` (store, location, held) from the stored tables: a row for each store.

    Returns store, found, held, erased, remaining, rows, passes, status (``completed`` or ``escalated``) and
    evidence_sha256, a digest of those numbers and of the table as read again. ``folder`` belongs to this run; the same
    folder again goes on with it. Rows written while it runs are not lost: only files that were read are replaced.
    """
    # What to erase is fixed at the start: it may have been read from the very tables that change.
    asked, out = f"{folder}/wanted", []
    if not _Files(spark, asked).exists(f"{asked}/_SUCCESS"):
        wanted.select("store", "location", "held").write.mode("overwrite").parquet(asked)
    wanted = spark.read.schema("store string, location string, held boolean").parquet(asked)
    for store in stores:
        base, files = f"{folder}/{store.name}", _Files(spark, store.path)
        found_at = f"{base}/found"
        if not files.exists(f"{found_at}/_SUCCESS"):
            held, due, _, _ = _left(spark, store, wanted)
            spark.createDataFrame([(held, due)], "held bigint, due bigint").coalesce(1).write.mode("overwrite").parquet(found_at)
        first = spark.read.parquet(found_at).first()
        n = 0
        while n < tries:
            step = f"{base}/pass={n}"
            if not files.exists(f"{step}/manifest/_SUCCESS"):
                if not _left(spark, store, wanted)[1]:
                    break
                _stage(spark, store, wanted, step)
            _swap(spark, store, step)
            n += 1
        held, remaining, rows, content = _left(spark, store, wanted)
        status = "completed" if not remaining else "escalated"
        out.append((store.name, first.held + first.due, held, first.due - remaining, remaining, n, status, rows, content))
    kinds = "store string, found bigint, held bigint, erased bigint, remaining bigint, passes int, status string, rows bigint, content string"
    report = spark.createDataFrame(out, kinds)
    evidence = sha256(F.concat_ws(":", *[F.col(c).cast("string") for c in ("store", "found", "held", "erased", "remaining", "rows", "content")]))
    return report.select("store", "found", "held", "erased", "remaining", "rows", "passes", "status", evidence.alias("evidence_sha256"))


def sweep_stored(spark: SparkSession, store: Store, expired: DataFrame, folder: str) -> DataFrame:
    """Delete the ``expired`` rows (location) of a store, by the same way; holds are taken out beforehand."""
    wanted = expired.select(F.lit(store.name).alias("store"), "location", F.lit(False).alias("held")).distinct()
    return erase_stored(spark, [store], wanted, folder)
