"""Latency and users per minute as mergeable sketches: stored once, merged into any window.

A minute of a group is one row: exact count and sum, a KLL sketch of the values and an HLL sketch of the
users, a few kilobytes whatever the traffic. A window merges its minutes' rows and never reads calls
again. ``RANK_ERROR`` is the share of ranks by which a quantile may be off, ``USER_ERROR`` the relative
error of the number of users (three standard errors). ``evaluation.latency_summary`` is the exact form.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K, LG_K = 400, 12
RANK_ERROR, USER_ERROR = 0.015, 0.05


def minute_of(ts: Column) -> Column:
    return F.floor(F.unix_micros(ts) / 60_000_000)


def minute_sketches(calls: DataFrame, by: Sequence[str], value: str, user: str) -> DataFrame:
    """One row per group and minute of ``calls`` (ts, whole ``value``, ``user``); calls without value count as none."""
    x = F.col(value).cast("bigint")
    return calls.where(x.isNotNull()).groupBy(*by, minute_of(F.col("ts")).alias("minute")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(x).alias("total"),
        F.kll_sketch_agg_bigint(x, F.lit(K)).alias("values"), F.hll_sketch_agg(F.col(user), F.lit(LG_K)).alias("users"),
    )


def merged(sketches: DataFrame, by: Sequence[str]) -> DataFrame:
    """The rows of ``sketches`` as one per group: filter minutes first for a window, or add ``window`` to ``by``."""
    return sketches.groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"),
        F.kll_merge_agg_bigint("values").alias("values"), F.hll_union_agg("users").alias("users"),
    )


def summary(sketches: DataFrame, by: Sequence[str], quantiles: Sequence[float] = (0.5, 0.95)) -> DataFrame:
    """Count and mean, exact; quantiles and users by sketch."""
    return merged(sketches, by).select(
        *by, F.col("n").alias("count"), F.round(F.col("total") / F.col("n"), 2).alias("mean"),
        *[F.kll_sketch_get_quantile_bigint("values", F.lit(q)).alias(f"p{round(100 * q)}") for q in quantiles],
        F.hll_sketch_estimate("users").alias("users"),
    )
