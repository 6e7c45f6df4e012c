"""Explicit schemas of the tables the jobs read and write."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Every table of the data model as DDL; constraints are listed in CHECKS and UNIQUE.
TABLES: dict[str, str] = {
    "tenants": "id string, slug string, data_residency string, status string, created_at timestamp",
    "api_keys": "id string, tenant_id string, prefix string, key_hash string, "
    "scopes array<string>, expires_at timestamp, revoked_at timestamp, created_by string, "
    "created_at timestamp, usecase_id string",
    "policies": "tenant_id string, version int, spec string, created_by string, "
    "created_at timestamp",
    "model_catalog": "id string, provider string, tier string, price_in decimal(10,4), "
    "price_out decimal(10,4), cache_read_multiplier decimal(5,3), "
    "cache_write_multiplier decimal(5,3), residency string, enabled boolean",
    "budgets": "tenant_id string, month date, limit_usd decimal(12,4), spent_usd decimal(12,6)",
    "usage_events": "ts timestamp, tenant_id string, key_id string, endpoint string, model string, "
    "tokens_in bigint, tokens_out bigint, cache_read int, cache_write int, cost_usd decimal(12,6), "
    "latency_ms bigint, cache_hit boolean, fallback boolean, status smallint, trace_id string, "
    "usecase_id string, user_ref_hash string",
    "documents": "id string, tenant_id string, collection string, title string, source_uri string, "
    "version int, acl_groups array<string>, status string, created_at timestamp, "
    "classification string, suggested_class string, owner string, steward string, "
    "cert_status string, certified_until date",
    "chunks": "id string, document_id string, tenant_id string, heading_path string, "
    "content string, embedding array<float>, terms array<string>, acl_groups array<string>, "
    "quarantined boolean, classification string, pii_tags array<string>",
    "prompts": "tenant_id string, name string, version int, template string, eval_score string, "
    "labels array<string>",
    "tools": "id string, mcp_url string, risk_level string, input_schema string, "
    "approved_by string, approved_at timestamp, max_classification string",
    "agent_runs": "id string, tenant_id string, agent string, state string, input string, "
    "steps string, cost_usd decimal(12,6), started_by string, updated_at timestamp",
    "approvals": "id string, run_id string, step int, tool string, arguments string, "
    "requested_at timestamp, decided_by string, decision string, reason string",
    "audit_logs": "ts timestamp, actor string, action string, resource string, detail string",
    "usage_event_receipts": "stream_id string, received_at timestamp",
    "guardrail_audit_receipts": "stream_id string, received_at timestamp",
    "usecases": "id string, tenant_id string, spec string, risk_tier string, status string, "
    "approved_by array<string>, review_due date, updated_at timestamp",
    "policy_decisions": "decision_id string, ts timestamp, trace_id string, tenant_id string, "
    "usecase_id string, purpose string, action string, max_class string, allow boolean, "
    "reasons array<string>, constraints string, bundle_revision string",
    "answer_provenance": "trace_id string, ts timestamp, tenant_id string, usecase_id string, "
    "user_ref_hash string, model string, decision_id string, output_class string, sources string",
    "subject_index": "subject_key string, store string, location string, first_seen timestamp",
    "subject_restrictions": "subject_key string, kind string, since timestamp, dsr_id string",
    "dsr_requests": "id string, kind string, subject_keys array<string>, status string, "
    "received_at timestamp, due_at timestamp, approved_by string, completed_at timestamp, "
    "evidence_sha256 string",
    "dsr_actions": "dsr_id string, store string, found int, action string, remaining_after int, "
    "attempts int, executed_at timestamp",
    "legal_holds": "scope string, reason string, created_by string, created_at timestamp, "
    "released_at timestamp",
    "data_quality_issues": "id string, kind string, subject string, detail string, "
    "assignee string, status string, created_at timestamp",
}

# Columns that may only hold the listed values.
CHECKS: dict[str, dict[str, tuple[str, ...]]] = {
    "tenants": {"data_residency": ("any", "local_only"), "status": ("active", "suspended")},
    "model_catalog": {"tier": ("small", "medium", "large"), "residency": ("cloud", "local")},
    "tools": {"risk_level": ("read", "write", "external")},
    "approvals": {"decision": ("approved", "rejected", "expired")},
}

UNIQUE: dict[str, tuple[tuple[str, ...], ...]] = {
    "tenants": (("id",), ("slug",)),
    "api_keys": (("id",), ("key_hash",)),
    "policies": (("tenant_id", "version"),),
    "model_catalog": (("id",),),
    "budgets": (("tenant_id", "month"),),
    "prompts": (("tenant_id", "name", "version"),),
    "usage_event_receipts": (("stream_id",),),
    "guardrail_audit_receipts": (("stream_id",),),
    "subject_index": (("subject_key", "store", "location"),),
    "dsr_actions": (("dsr_id", "store"),),
}

STREAM_RECORD = "stream_id string, fields map<string,string>"


def violations(df: DataFrame, table: str) -> DataFrame:
    """Count rows breaking each CHECK, and keys breaking each UNIQUE, of a table."""
    checks = CHECKS.get(table, {})
    tests = [
        F.count_if(F.col(c).isNotNull() & ~F.col(c).isin(*allowed)).alias(f"check:{c}")
        for c, allowed in checks.items()
    ]
    parts = []
    if tests:
        one = df.agg(*tests)
        parts.append(
            one.select(F.explode(F.create_map(*[
                x for c in one.columns for x in (F.lit(c), F.col(f"`{c}`"))
            ])).alias("rule", "broken"))
        )
    for key in UNIQUE.get(table, ()):
        repeated = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        parts.append(
            repeated.agg(F.count(F.lit(1)).alias("broken"))
            .select(F.lit(f"unique:{','.join(key)}").alias("rule"), "broken")
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
