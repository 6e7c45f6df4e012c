"""Encrypted placeholder mappings with expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import MAPPING_TTL_SECONDS
from ..functions.crypto import open_sealed, seal
from ..frames.skew import latest_within


def store_key(call_id: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix), call_id)


def put(
    mappings: DataFrame,
    key_hex: str,
    prefix: str = "pii-map:",
    mapping: str = "mapping",
    nonce: Column | None = None,
) -> DataFrame:
    """Seal each request's mapping, bound to its full key name."""
    name = store_key(F.col("call_id"), prefix)
    return mappings.withColumn("store_key", name).withColumn(
        "blob", seal(F.to_json(F.col(mapping)), key_hex, name, nonce)
    ).drop(mapping)


def get(
    asked: DataFrame,
    stored: DataFrame,
    key_hex: str,
    prefix: str = "pii-map:",
    ttl_seconds: int = MAPPING_TTL_SECONDS,
) -> DataFrame:
    """Mapping visible to each lookup: the last one put no more than the TTL before ``get_ts``.

    Expired, missing, or moved blobs give an empty mapping.
    """
    keyed = asked.withColumn("store_key", store_key(F.col("call_id"), prefix))
    seen = latest_within(
        keyed, stored.select("store_key", "put_ts", "blob"), ["store_key"],
        "get_ts", "put_ts", ttl_seconds, "blob",
    )
    plain = open_sealed(F.col("blob"), key_hex, F.col("store_key"))
    empty = F.from_json(F.lit("{}"), "map<string,string>")
    return seen.withColumn(
        "mapping", F.coalesce(F.from_json(plain, "map<string,string>"), empty)
    ).drop("blob")
