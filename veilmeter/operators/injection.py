"""Prompt-injection scan over requests and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import injection


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``findings``: first match of each rule with its evidence."""
    return df.withColumn("findings", injection.findings(F.col(text)))


def decide(requests: DataFrame, text: str = "text", mode: str = "injection_mode") -> DataFrame:
    """Add ``rules`` and ``blocked``. Scanning happens in block mode only, which is the default;
    evidence never leaves this step."""
    active = F.coalesce(F.lower(F.col(mode)), F.lit("block")) == "block"
    none = F.array().cast("array<string>")
    scanned = requests.withColumn(
        "rules", F.when(active, injection.rules(F.col(text))).otherwise(none)
    )
    return scanned.withColumn("blocked", F.size("rules") > 0)


def quarantine(chunks: DataFrame, text: str = "content") -> DataFrame:
    """Add ``quarantined``: the chunk shows a finding."""
    return chunks.withColumn("quarantined", F.size(injection.rules(F.col(text))) > 0)


def document_status(chunks: DataFrame, document: str = "document_id") -> DataFrame:
    """Status of each document after its chunks were scanned."""
    return chunks.groupBy(document).agg(
        F.count(F.lit(1)).alias("chunks"),
        F.count_if("quarantined").alias("quarantined_chunks"),
        F.when(F.bool_or("quarantined"), "partially_quarantined").otherwise("ready")
        .alias("status"),
    )
