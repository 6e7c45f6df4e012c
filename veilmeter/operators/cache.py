"""Answer cache replay: keys, exact and semantic hits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pii
from ..functions.crypto import sha256
from ..session import durable
from . import vector_links, vectors


def normalised_prompt(prompt: Column) -> Column:
    """Lower case, blanks collapsed."""
    return F.trim(F.regexp_replace(F.lower(prompt), r"\s+", " "))


def exact_key(tenant: Column, prompt: Column, model: Column, parameters: Column) -> Column:
    """Digest of the parts as a JSON array: tenants share no answers, and an absent part is no empty one."""
    return sha256(F.to_json(F.array(tenant, normalised_prompt(prompt), model, parameters)))


def cacheable(df: DataFrame, text: str = "text") -> DataFrame:
    """Requests without personal data, at most mildly random, and the same for every user."""
    clean = F.size(pii.entities(F.col(text))) == 0
    return df.filter((F.col("temperature") <= 0.3) & ~F.col("user_dependent") & clean)


def exact_hits(requests: DataFrame, ttl_seconds: int, key: str = "cache_key", id_: str = "id"):
    """Add ``hit``: an earlier request with the same key came within the TTL.

    Time is cut into slices of the TTL: within a slice every earlier request is recent enough, and
    of the previous slice only the last one matters. Two aggregates answer for any key size.
    """
    micros = ttl_seconds * 1_000_000
    us = F.unix_micros("ts")
    sliced = requests.withColumn("_us", us).withColumn("_slice", F.floor(us / micros))
    ends = sliced.groupBy(key, "_slice").agg(
        F.min(F.struct("_us", id_)).alias("_first"), F.max("_us").alias("_last")
    )
    # Each slice's own start next to the end of the slice before it.
    before = ends.select(key, (F.col("_slice") + 1).alias("_slice"), F.col("_last").alias("_before"))
    marks = ends.select(key, "_slice", "_first").join(before, [key, "_slice"], "left")
    joined = sliced.join(marks, [key, "_slice"])
    hit = (F.struct("_us", id_) > F.col("_first")) | F.coalesce(
        F.col("_us") - F.col("_before") <= micros, F.lit(False)
    )
    return joined.select(*[F.col(c) for c in requests.columns], hit.alias("hit"))


def _earlier(left: pd.DataFrame, rows: pd.DataFrame):
    return left["at"].to_numpy()[:, None] < rows["at"].to_numpy()[None, :]


def _best_earlier(at_least: float):
    """Each row's best earlier row among those that met, if it reaches the limit; ties go to the smaller id."""

    def each(ids: np.ndarray, at: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rough = np.where(at[None, :] < at[:, None], x @ x.T, -2.0)
        # What rounding could decide is scored again, row by row.
        i, j = np.nonzero(rough >= np.maximum(rough.max(axis=1), at_least)[:, None] - 1e-6)
        score = np.round(np.einsum("ij,ij->i", x[i], x[j]), 9)
        good = score >= at_least
        i, j, score = i[good], j[good], score[good]
        order = np.lexsort((j, -score, i))
        order = order[np.append(True, np.diff(i[order]) > 0)] if len(order) else order
        return ids[i[order]], ids[j[order]], score[order]

    return each


def semantic_hits(requests: DataFrame, at_least: float = 0.95, exhaustive: bool = True) -> DataFrame:
    """Best earlier request of the same tenant with a cosine of at least the limit.

    ``requests`` holds tenant_id, id, at, vector. A repeat of an identical vector hits its first
    occurrence, so only distinct vectors are compared: each with each of its tenant, or, not
    ``exhaustive``, those that share a band of hyperplanes (``vector_links.miss_rate`` says what is missed).
    """
    vector_keys = ["tenant_id", "vector"]
    firsts = requests.groupBy(*vector_keys).agg(F.min(F.struct("at", "id")).alias("_first"))
    distinct = firsts.select("tenant_id", "vector", F.col("_first.id").alias("id"), F.col("_first.at").alias("at"))
    if exhaustive:
        found = vectors.best_partners(distinct, distinct, ["tenant_id"], 1, at_least, _earlier).select(
            F.col("right_id").alias("id"), F.col("left_id").alias("hit_id"), "score"
        )
    else:
        kind = distinct.schema["id"].dataType.simpleString()
        written = durable(distinct.where("tenant_id IS NOT NULL AND vector IS NOT NULL"))
        each = vector_links.by_bucket(_best_earlier(at_least), ["id", "at"], ["id", "hit_id", "score"])
        best = vector_links.meetings(written, "tenant_id").applyInPandas(each, f"id {kind}, hit_id {kind}, score double")
        found = best.groupBy("id").agg(F.max_by("hit_id", F.struct("score", -F.col("hit_id"))).alias("hit_id"), F.max("score").alias("score"))
    repeats = (
        requests.join(firsts, vector_keys)
        .filter(F.col("id") != F.col("_first.id"))
        .select("id", F.col("_first.id").alias("hit_id"), F.lit(1.0).alias("score"))
    )
    return found.unionByName(repeats)
