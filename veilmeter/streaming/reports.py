"""Windowed counters and alerts over live streams. Watermarks are used here only: facts are never
dropped for being late."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def minute_counters(requests: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Requests and tokens per tenant and minute."""
    return (
        requests.withWatermark("ts", late)
        .groupBy("tenant", F.window("ts", "1 minute"))
        .agg(F.count(F.lit(1)).alias("requests"), F.sum("tokens").alias("tokens"))
    )


def error_alerts(calls: DataFrame, by: str = "provider", share: float = 0.05, late: str = "10 minutes"):
    """Five-minute windows, sliding by one, whose error share is above the limit."""
    return (
        calls.withWatermark("ts", late)
        .groupBy(by, F.window("ts", "5 minutes", "1 minute"))
        .agg(F.count(F.lit(1)).alias("calls"), F.count_if("failed").alias("errors"))
        .filter(F.col("errors") > F.lit(share) * F.col("calls"))
    )
