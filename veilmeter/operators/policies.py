"""Tenant policy documents: validation, upsert and the per-request privacy mode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import INJECTION_MODES, PII_MODES, RESIDENCY
from ..functions.numbers import read_int, read_uuid
from ..functions.pii import pii_mode, pii_restore
from ..functions.text import computed_once

SECTIONS = ("tenant", "limits", "models", "guardrails")


def check_policies(documents: DataFrame, spec: str = "spec") -> DataFrame:
    """Add the array ``broken`` with the name of every rule a policy document (JSON) breaks."""
    parsed = computed_once(documents.select("*", F.col(spec).alias("_spec")), {"_v": F.try_parse_json("_spec")})

    def at(path: str, kind: str) -> Column:
        return F.try_variant_get("_v", f"$.{path}", kind)

    # Each value is taken from the document once, whatever number of rules and branches read it.
    texts = ("tenant.id", "tenant.slug", "tenant.data_residency", "guardrails.pii", "guardrails.injection",
             "version", "limits.rpm", "limits.tpm")
    numbers = ("version", "limits.rpm", "limits.tpm", "limits.warning_budget_usd", "limits.monthly_budget_usd")
    kinds = (*SECTIONS, "guardrails.pii_restore")
    read = computed_once(parsed, {
        "_texts": F.struct(*[at(p, "string").alias(p) for p in texts]),
        "_numbers": F.struct(*[at(p, "double").alias(p) for p in numbers]),
        "_kinds": F.struct(*[F.coalesce(F.schema_of_variant(at(p, "variant")), F.lit("VOID")).alias(p) for p in kinds]),
        "_allow": at("models.allow", "array<string>"),
    })

    def text(path: str) -> Column:
        return F.col("_texts")[path]

    def number(path: str) -> Column:
        return F.col("_numbers")[path]

    def kind(path: str) -> Column:
        return F.col("_kinds")[path]

    def positive(path: str) -> Column:
        return F.coalesce(F.coalesce(read_int(text(path)), F.floor(number(path))) > 0, F.lit(False))

    allow = F.col("_allow")
    warning, budget = number("limits.warning_budget_usd"), number("limits.monthly_budget_usd")
    rules = [
        *[(f"section:{s}", ~F.startswith(kind(s), F.lit("OBJECT"))) for s in SECTIONS],
        ("tenant.id", read_uuid(text("tenant.id")).isNull()),
        ("tenant.slug", text("tenant.slug").isNull()),
        ("tenant.data_residency",
         ~F.coalesce(text("tenant.data_residency").isin(*RESIDENCY), F.lit(False))),
        ("guardrails.pii", ~F.coalesce(text("guardrails.pii").isin(*PII_MODES), F.lit(False))),
        ("guardrails.pii_restore", kind("guardrails.pii_restore") != "BOOLEAN"),
        ("guardrails.injection",
         ~F.coalesce(text("guardrails.injection").isin(*INJECTION_MODES), F.lit(False))),
        ("models.allow", F.coalesce(F.size(allow), F.lit(0)) <= 0),
        ("version", ~positive("version")),
        ("limits.rpm", ~positive("limits.rpm")),
        ("limits.tpm", ~positive("limits.tpm")),
        ("limits.budget", warning.isNull() | budget.isNull()),
        ("limits.warning", F.coalesce(warning > budget, F.lit(False))),
    ]
    broken = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules]))
    return read.select(*[F.col(c) for c in documents.columns if c != "broken"], broken.alias("broken"))


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """Union of both, keeping the row loaded last for every key.

    The newest row is an aggregate with map-side combine, so a much repeated key stays cheap.
    """
    both = current.unionByName(incoming)
    rest = [c for c in both.columns if c not in keys]
    newest = both.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.col(sequence)).alias("_row")
    )
    return newest.select(*keys, "_row.*").select(*both.columns)


def latest_version(policies: DataFrame, key: str = "tenant_id") -> DataFrame:
    """Current version of each policy."""
    w = Window.partitionBy(key).orderBy(F.col("version").desc())
    return policies.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def privacy_mode(requests: DataFrame, mode: str = "raw_mode", restore: str = "raw_restore"):
    """Add the effective ``mode`` and ``restore`` of the key's policy."""
    effective = pii_mode(F.col(mode))
    return requests.select(
        "*", effective.alias("mode"), pii_restore(effective, F.col(restore)).alias("restore")
    )
