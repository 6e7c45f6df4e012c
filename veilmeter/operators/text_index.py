"""Stored positional index of chunks, and ranked search that reads only blocks which can still win.

A posting is one term of one chunk with its positions. Postings lie in shards by term, sorted by
term and block, where a block is a range of chunk ids; a second table holds each term's blocks with
their largest count. A search first ranks blocks by an upper bound from those counts, scores the best
few, and then reads only the blocks whose bound reaches the k-th score found; the others cannot
change the answer. A frequent term meets the questions block by block, so it is no single key.

Rank is cover density: every shortest stretch of positions that holds all terms of the question adds
one over its length, less the terms it must hold; adjacent words add 1. A one-word question counts
the word.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import durable, shared_dir
from .retrieval import CANDIDATES, asked_terms, terms, visible_chunks

BLOCK_IDS = 128
SHARDS = 64
#: Blocks of a question scored before the others are judged.
FIRST = 4


#: Chunks whose words are sorted at once.
TOGETHER = 256


def _positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each term of a chunk with its positions in order."""
    for batch in batches:
        for first in range(0, batch.num_rows, TOGETHER):
            rows = batch.slice(first, TOGETHER)
            lists = rows.column("_words")
            words = pc.list_flatten(lists)
            in_text = pc.list_parent_indices(words).to_numpy()
            chunk = pc.list_parent_indices(lists).to_numpy()[in_text]
            words = pc.list_flatten(words).dictionary_encode()
            term = words.indices.to_numpy()
            at = np.arange(len(term)) - np.searchsorted(in_text, in_text)
            order = np.lexsort((at, term, chunk))
            chunk, term = chunk[order], term[order]
            begins = np.flatnonzero(np.append(True, (chunk[1:] != chunk[:-1]) | (term[1:] != term[:-1]))) if len(term) else order
            kept = rows.drop_columns(["_words"]).take(pa.array(chunk[begins]))
            offsets = pa.array(np.append(begins, len(term)).astype(np.int32))
            positions = pa.ListArray.from_arrays(offsets, pa.array(at[order].astype(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, words.dictionary.take(pa.array(term[begins])), positions], names=[*kept.schema.names, "term", "positions"]
            )


def _shard(tenant: Column, term: Column) -> Column:
    return F.pmod(F.xxhash64(tenant, term), F.lit(SHARDS)).cast("int")


def build(chunks: DataFrame, path: str, text: str = "content") -> None:
    """Write the index of the visible ``chunks`` (tenant_id, id, acl_groups, quarantined, text) at ``path``."""
    key = ["tenant_id", "id", "acl_groups"]
    # Rows of one chunk come together before they are cut into words; then no word is shuffled to be counted.
    whole = visible_chunks(chunks).groupBy(*key).agg(F.collect_list(text).alias("_texts"))
    split = whole.select(*key, F.transform("_texts", terms).alias("_words"))
    types = {f.name: f.dataType.simpleString() for f in whole.schema.fields}
    schema = ", ".join(f"{c} {types[c]}" for c in key) + ", term string, positions array<int>"
    found = split.mapInArrow(_positions, schema).select(
        "tenant_id", "term", F.floor(F.col("id") / BLOCK_IDS).alias("block"), "id", "acl_groups", "positions",
        _shard(F.col("tenant_id"), F.col("term")).alias("shard"),
    )
    placed = found.hint("rebalance", "shard").sortWithinPartitions("shard", "tenant_id", "term", "block")
    placed.write.partitionBy("shard").parquet(f"{path}/postings")
    stored = chunks.sparkSession.read.schema(found.schema).parquet(f"{path}/postings")
    blocks = stored.groupBy("shard", "tenant_id", "term", "block").agg(F.max(F.size("positions")).alias("most"))
    blocks.hint("rebalance", "shard").sortWithinPartitions("shard", "tenant_id", "term").write.partitionBy("shard").parquet(f"{path}/blocks")


def _density(places: Column, n: Column) -> Column:
    """Cover density of ``places``: (position, number of the term from 0) in order of position."""

    def step(acc: Column, p: Column) -> Column:
        last = F.transform(acc["last"], lambda old, i: F.when(i == p["term"], p["at"]).otherwise(old))
        start = F.array_min(last)
        whole = (start >= 0) & (start > acc["start"])
        gain = F.when(whole, 1 / (p["at"] - start - n + 2).cast("double")).otherwise(F.lit(0.0))
        return F.struct(last.alias("last"), F.when(whole, start).otherwise(acc["start"]).alias("start"), (acc["score"] + gain).alias("score"))

    zero = F.struct(F.array_repeat(F.lit(-1), n).alias("last"), F.lit(-1).alias("start"), F.lit(0.0).alias("score"))
    return F.aggregate(places, zero, step, lambda a: F.round(a["score"], 9))


def _scored(postings: DataFrame, asked: DataFrame, blocks: DataFrame) -> DataFrame:
    """(query_id, chunk_id, score) of the readable chunks with all terms in the given (query_id, block) rows."""
    wanted = asked.join(blocks.select("query_id", "block"), "query_id")
    hits = postings.join(wanted, ["tenant_id", "term", "block"]).where(F.arrays_overlap("acl_groups", "groups"))
    each = F.transform("positions", lambda p: F.struct(p.alias("at"), F.col("nth").alias("term")))
    found = hits.groupBy("query_id", F.col("id").alias("chunk_id"), "n_terms").agg(F.collect_list(each).alias("lists"))
    found = found.where(F.size("lists") == F.col("n_terms"))
    return found.select("query_id", "chunk_id", _density(F.array_sort(F.flatten("lists")), F.col("n_terms")).alias("score"))


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = CANDIDATES, first: int = FIRST) -> tuple[DataFrame, DataFrame]:
    """The best ``k`` chunks of each question (tenant_id, id, groups, question) that hold all its terms, as
    (query_id, chunk_id, score, rank); and (query_id, blocks, read), the blocks that have all terms
    and those whose postings were read.

    Exact: a block is left out only if its bound is below the k-th score. Ties go to the smaller id.
    Questions without words find nothing.
    """
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("term")) - 1
    asked = durable(asked_terms(queries).withColumn("nth", nth).withColumn("shard", _shard(F.col("tenant_id"), F.col("term"))))
    shards = [r.shard for r in asked.select("shard").distinct().collect()]  # SHARDS numbers at most
    postings = spark.read.parquet(f"{path}/postings").where(F.col("shard").isin(shards)).drop("shard")
    stored = spark.read.parquet(f"{path}/blocks").where(F.col("shard").isin(shards))
    bounds = durable(
        stored.join(asked.drop("groups"), ["shard", "tenant_id", "term"]).groupBy("query_id", "block", "n_terms")
        .agg(F.count(F.lit(1)).alias("found"), F.sum("most").alias("positions"))
        .where(F.col("found") == F.col("n_terms"))
        # No two covers end at the same place, and the first needs all terms.
        .select("query_id", "block", (F.col("positions") - F.col("n_terms") + 1).alias("bound"))
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
    placed = durable(bounds.withColumn("place", F.row_number().over(best)))
    early = durable(_scored(postings, asked, placed.where(F.col("place") <= first)))
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    limit = early.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") == k).select("query_id", F.col("score").alias("limit"))
    rest = durable(
        placed.where(F.col("place") > first).join(limit, "query_id", "left")
        .where(F.col("limit").isNull() | (F.col("bound") >= F.col("limit"))).select("query_id", "block")
    )
    every = early.unionByName(_scored(postings, asked, rest))
    ranked = every.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
    read = rest.unionByName(placed.where(F.col("place") <= first).select("query_id", "block")).groupBy("query_id").agg(F.count(F.lit(1)).alias("read"))
    return ranked, bounds.groupBy("query_id").agg(F.count(F.lit(1)).alias("blocks")).join(read, "query_id")


def new_path(spark: SparkSession) -> str:
    """A fresh folder for an index among the shared ones."""
    return f"{shared_dir(spark).rstrip('/')}/indexes/{uuid.uuid4().hex}"
