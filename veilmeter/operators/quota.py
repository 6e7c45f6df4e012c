"""Per-tenant minute quotas replayed over request logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import WINDOW_SECONDS
from ..functions.crypto import short_hash
from ..functions.numbers import read_int
from ..functions.text import blank_to_null
from ..frames import skew


def rate_policy(keys: DataFrame, metadata: str = "metadata", prefix: str = "") -> DataFrame:
    """Read trusted key metadata (JSON) into tenant, rpm and tpm.

    ``policy`` is ``none`` unless all three are present and ``invalid`` when a limit is not a
    positive whole number; booleans are not numbers, and neither is ``60.0`` a whole one.
    """
    v = F.try_parse_json(F.col(metadata))

    def raw(name: str) -> Column:
        return F.try_variant_get(v, f"$.{prefix}{name}", "variant")

    def limit(name: str) -> Column:
        whole = F.schema_of_variant(raw(name)).isin("BIGINT", "STRING")
        text = F.try_variant_get(v, f"$.{prefix}{name}", "string")
        number = F.when(whole, read_int(text))
        return F.when(number > 0, number)

    is_text = F.coalesce(F.schema_of_variant(raw("tenant")) == "STRING", F.lit(False))
    tenant = F.when(is_text, blank_to_null(F.try_variant_get(v, f"$.{prefix}tenant", "string")))

    def missing(name: str) -> Column:
        return F.coalesce(F.schema_of_variant(raw(name)) == "VOID", F.lit(True))

    absent = tenant.isNull() | missing("rpm_limit") | missing("tpm_limit")
    rpm, tpm = limit("rpm_limit"), limit("tpm_limit")
    return keys.select(
        "*",
        F.when(absent, "none").when(rpm.isNull() | tpm.isNull(), "invalid").otherwise("active")
        .alias("policy"),
        F.when(~absent, tenant).alias("tenant"),
        F.when(~absent, rpm).alias("rpm"),
        F.when(~absent, tpm).alias("tpm"),
    )


def minute_bucket(epoch_seconds: Column) -> Column:
    return F.floor(epoch_seconds / WINDOW_SECONDS).cast("bigint")


def counter_key(tenant: Column, dimension: str, bucket: Column, prefix: str = "rate") -> Column:
    return F.concat_ws(":", F.lit(prefix), F.lit(dimension), short_hash(tenant), bucket)


def replay(
    requests: DataFrame,
    tenant: str = "tenant",
    bucket: str = "bucket",
    order: tuple[str, ...] = ("ts", "request_id"),
    tokens: str = "tokens",
    slice: Column | None = None,
) -> DataFrame:
    """Decide every request of a log that carries its tenant's ``rpm`` and ``tpm``.

    A refused request stays counted, so the request limit is a rank and the token limit a running
    sum. Only requests that passed the rank add tokens and at most ``rpm`` of them share a
    minute, so the second window is small even when a minute is huge. ``slice`` cuts a minute along
    ``order``, e.g. by the second, for tenants whose minute is too large for one task.
    """
    ranked = skew.running(
        requests, [tenant, bucket], order, rank="rpm_count", slice=slice
    )
    passed = F.col("rpm_count") <= F.col("rpm")
    upto = (
        Window.partitionBy(tenant, bucket).orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    counted = ranked.filter(passed).withColumn("tpm_count", F.sum(tokens).over(upto))
    refused = ranked.filter(~passed).withColumn("tpm_count", F.lit(None).cast("bigint"))
    reason = F.when(F.col("tpm_count").isNull(), "rpm").when(F.col("tpm_count") > F.col("tpm"), "tpm")
    return (
        counted.unionByName(refused)
        .withColumn("reason", reason)
        .withColumn("admitted", F.col("reason").isNull())
    )
