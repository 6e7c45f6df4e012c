"""Classification, policy decisions, provenance, data-subject rights, retention and registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import LEVELS
from ..functions import pii
from ..functions.crypto import hmac_sha256, sha256
from ..functions.numbers import ascii_digits
from ..functions.text import computed_once
from ..frames import skew
from ..frames.skew import latest_within

# Rules that suggest a label, and kinds of personal data per tag.
SALARY_WORDS = ("bảng lương", "mức lương", "thu nhập cá nhân")
SECRET_MARKS = ("MẬT", "KHÔNG PHỔ BIẾN", "CONFIDENTIAL")
SENSITIVE_KINDS = ("CCCD", "BANK")
DEFAULT_LEVEL = "internal"

# Handling per action and level; "ask" names a condition.
HANDLING = (
    ("cloud_model", ("yes", "ask", "no", "no")),
    ("local_model", ("yes", "yes", "yes", "ask")),
    ("exact_cache", ("yes", "yes", "ask", "no")),
    ("semantic_cache", ("yes", "yes", "no", "no")),
    ("trace_content", ("yes", "yes", "no", "no")),
    ("send_out", ("yes", "ask", "ask", "no")),
)

# What erasing means in each store.
ERASURE = {
    "minio": "redact_version", "chunks": "delete", "redis": "delete", "langfuse": "delete",
    "usage": "anonymise", "agent_runs": "redact",
}


# --- classification --------------------------------------------------------------------------

def rank(level: Column) -> Column:
    """Order of a level, NULL for an unknown one."""
    out = F
    for n, name in enumerate(LEVELS):
        out = out.when(level == name, n)
    return out.otherwise(F.lit(None).cast("int"))


def level(n: Column) -> Column:
    return F.get(F.array(*[F.lit(x) for x in LEVELS]), n)


def context_labels(parts: DataFrame, request: str, label: str = "label") -> DataFrame:
    """Label of each request's context: the highest of its input, chunks, tables and tools."""
    return parts.groupBy(request).agg(level(F.max(rank(F.col(label)))).alias("context_label"))


def suggest_labels(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``suggested`` and the ``rules`` behind it, from personal data and keywords."""
    found = computed_once(df, {
        "_kinds": F.transform(pii.entities(F.col(text)), lambda e: e["kind"]),
        "_lower": F.lower(F.col(text)),
    })

    def any_of(column: str, words) -> Column:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(F.col(column), F.lit(w))
        return hit

    sensitive = F.arrays_overlap("_kinds", F.array(*[F.lit(k) for k in SENSITIVE_KINDS]))
    rules = F.array_compact(F.array(
        F.when(sensitive, F.lit("pii_sensitive")),
        F.when(any_of("_lower", SALARY_WORDS), F.lit("salary_keywords")),
        F.when(any_of(text, SECRET_MARKS), F.lit("marked_confidential")),
    ))
    out = found.withColumn("rules", rules).drop("_kinds", "_lower")
    suggested = (
        F.when(F.array_contains("rules", "pii_sensitive"), "restricted")
        .when(F.size("rules") > 0, "confidential")
        .otherwise(DEFAULT_LEVEL)
    )
    return out.withColumn("suggested", suggested)


def effective_label(owner: Column, suggested: Column, confirmed: Column) -> Column:
    """A confirmed label stands; until then the higher of choice and suggestion applies."""
    return F.when(confirmed, owner).otherwise(level(F.greatest(rank(owner), rank(suggested))))


def pii_tag(kinds: Column) -> Column:
    sensitive = F.arrays_overlap(kinds, F.array(*[F.lit(k) for k in SENSITIVE_KINDS]))
    return F.when(F.size(kinds) == 0, "pii:none").when(sensitive, "pii:sensitive").otherwise("pii:basic")


def handling(spark) -> DataFrame:
    """Handling matrix as rows (action, label, handling)."""
    rows = [(a, LEVELS[n], h) for a, hs in HANDLING for n, h in enumerate(hs)]
    return spark.createDataFrame(rows, "action string, label string, handling string")


# --- policy decisions ------------------------------------------------------------------------

def decide(requests: DataFrame, usecases: DataFrame, external_purposes: tuple[str, ...]):
    """Deny reasons (sorted), constraints and ``allow`` of each request.

    ``requests``: usecase_id, action, purpose, context_label, pii_tags, tool, tool_label.
    ``usecases``: usecase_id, status, purposes, max_label. An unknown use case has no registered
    purpose, while rules about its status and label stay silent.
    """
    registered = usecases.select(
        "usecase_id", F.col("status").alias("_status"), F.col("purposes").alias("_purposes"),
        rank(F.col("max_label")).alias("_max"), F.lit(True).alias("_known"),
    )
    joined = requests.join(registered, "usecase_id", "left")
    context = rank(F.col("context_label"))

    def yes(c: Column) -> Column:
        return F.coalesce(c, F.lit(False))

    confidential = yes(context >= LEVELS.index("confidential"))
    tool = F.concat(F.lit("tool_"), F.col("tool"), F.lit("_cannot_receive_"), F.col("context_label"))
    reasons = [
        (F.col("_known").isNull(), F.lit("usecase_unknown")),
        (yes(F.col("_status") != "approved"), F.lit("usecase_not_approved")),
        (~yes(F.array_contains("_purposes", F.col("purpose"))), F.lit("purpose_not_registered")),
        (yes(context > F.col("_max")), F.lit("classification_exceeds_usecase")),
        ((F.col("action") == "llm_call") & yes(F.col("context_label") == "restricted"),
         F.lit("restricted_data_in_llm")),
        (F.col("purpose").isin(*external_purposes) & confidential,
         F.lit("external_purpose_with_confidential")),
        ((F.col("action") == "tool_call") & yes(context > rank(F.col("tool_label"))), tool),
    ]
    constraints = [
        (confidential, F.lit("residency=local")),
        (confidential, F.lit("semantic_cache=false")),
        (confidential, F.lit("trace_content=false")),
        (yes(F.array_contains("pii_tags", "pii:sensitive")), F.lit("pii=mask")),
    ]

    def collected(rules) -> Column:
        return F.array_sort(F.array_compact(F.array(*[F.when(c, x) for c, x in rules])))

    return joined.select(
        *[F.col(c) for c in requests.columns],
        collected(reasons).alias("reasons"),
        collected(constraints).alias("constraints"),
    ).withColumn("allow", F.size("reasons") == 0)


def decide_in_outage(requests: DataFrame, decisions: DataFrame, cache_seconds: int = 30):
    """What happens while no policy decision can be had: high labels are blocked, others use the
    decision cached for their key, or a safe default."""
    seen = latest_within(requests, decisions, ["cache_key"], "ts", "ts", cache_seconds, "allow")
    high = rank(F.col("context_label")) >= LEVELS.index("confidential")
    outcome = (
        F.when(high, "policy_unavailable")
        .when(F.col("allow"), "cached_allow")
        .when(~F.col("allow"), "cached_deny")
        .when(F.exists("pii_tags", lambda t: t != "pii:none"), "default_local")
        .otherwise("default_allow")
    )
    return seen.withColumn("outcome", outcome)


def denials(decisions: DataFrame) -> DataFrame:
    """Denials per day and reason."""
    return decisions.select(F.to_date("ts").alias("day"), F.explode("reasons").alias("reason")).groupBy(
        "day", "reason"
    ).agg(F.count(F.lit(1)).alias("denials"))


# --- provenance ------------------------------------------------------------------------------

_SOURCES = "array<struct<document_id:string,version:int,chunk_id:string,classification:string,table:string>>"


def provenance_coverage(traces: DataFrame, provenance: DataFrame) -> DataFrame:
    """Answers with and without a provenance record, per tenant."""
    known = provenance.select("trace_id", F.lit(1).alias("_has")).dropDuplicates(["trace_id"])
    return traces.join(known, "trace_id", "left").groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("answers"), F.count(F.when(F.col("_has").isNull(), 1)).alias("missing")
    )


def lineage_edges(provenance: DataFrame) -> DataFrame:
    """Daily edges source -> use case with the number of uses."""
    used = provenance.select(
        F.to_date("ts").alias("day"), "usecase_id", F.explode(F.from_json("sources", _SOURCES)).alias("s")
    )
    source = F.coalesce(
        F.concat(F.lit("table:"), F.col("s.table")), F.concat(F.lit("document:"), F.col("s.document_id"))
    )
    return used.groupBy("day", source.alias("source"), "usecase_id").agg(F.count(F.lit(1)).alias("uses"))


def confidential_at_cloud(provenance: DataFrame, catalog: DataFrame) -> DataFrame:
    """Answers whose context was at least confidential and went to a cloud model."""
    cloud = catalog.filter("residency = 'cloud'").select(F.col("id").alias("model"))
    high = rank(F.col("output_class")) >= LEVELS.index("confidential")
    return provenance.filter(high).join(cloud, "model", "left_semi")


# --- data subjects ---------------------------------------------------------------------------

def normalised_identifier(kind: Column, value: Column) -> Column:
    bare = F.regexp_replace(ascii_digits(value), r"[\s.\-]", "")
    return (
        F.when(kind == "PHONE", F.regexp_replace(bare, r"^\+84", "0"))
        .when(kind == "EMAIL", F.lower(value))
        .when(kind.isin("CCCD", "BANK"), bare)
        .otherwise(value)
    )


def subject_key(secret: bytes, kind: Column, value: Column) -> Column:
    """Key of a person's identifier that cannot be guessed back without the secret."""
    message = F.concat(kind, F.lit(":"), normalised_identifier(kind, value))
    return F.concat(F.lit("sk_"), F.substring(hmac_sha256(secret, message), 1, 32))


def upsert_subject_index(current: DataFrame, seen: DataFrame) -> DataFrame:
    """One row per key, store and location with the earliest sighting."""
    return current.unionByName(seen).groupBy("subject_key", "store", "location").agg(
        F.min("first_seen").alias("first_seen")
    )


def find_subject(requests: DataFrame, index: DataFrame) -> DataFrame:
    """Locations of each request's subject keys in every store."""
    wanted = requests.select(F.col("id").alias("dsr_id"), F.explode(F.array_distinct("subject_keys")).alias("subject_key"))
    return wanted.join(index, "subject_key").select("dsr_id", "subject_key", "store", "location")


def plan_erasure(found: DataFrame, holds: DataFrame) -> DataFrame:
    """Action for each found location; under a legal hold processing is only restricted."""
    held = holds.filter("released_at IS NULL").select("subject_key", F.lit(True).alias("_held")).distinct()
    action = F
    for store, what in ERASURE.items():
        action = action.when(F.col("store") == store, what)
    joined = found.join(held, "subject_key", "left")
    return joined.withColumn(
        "action", F.when(F.col("_held"), "restrict").otherwise(action.otherwise("manual"))
    ).drop("_held")


def erase(index: DataFrame, plan: DataFrame) -> DataFrame:
    """The index without what was erased; running it again changes nothing."""
    gone = plan.filter(~F.col("action").isin("restrict", "manual"))
    return index.join(gone, ["subject_key", "store", "location"], "left_anti")


def anonymise(usage: DataFrame, plan: DataFrame) -> DataFrame:
    """Usage rows whose location was erased lose their user reference and nothing else."""
    gone = plan.filter("store = 'usage' AND action = 'anonymise'").select("location").distinct()
    marked = usage.join(gone.withColumn("_gone", F.lit(True)), "location", "left")
    return marked.withColumn(
        "user_ref_hash", F.when(F.col("_gone").isNull(), F.col("user_ref_hash"))
    ).drop("_gone")


def erasure_report(requests: DataFrame, index: DataFrame, holds: DataFrame) -> DataFrame:
    """Find, erase, find again: per request and store what was found, held and is left."""
    found = find_subject(requests, index)
    plan = plan_erasure(found, holds)
    left = find_subject(requests, erase(index, plan))
    before = plan.groupBy("dsr_id", "store").agg(
        F.count(F.lit(1)).alias("found"), F.count_if(F.col("action") == "restrict").alias("held"),
        F.max(F.when(F.col("action") != "restrict", F.col("action"))).alias("action"),
    )
    after = left.groupBy("dsr_id", "store").agg(F.count(F.lit(1)).alias("remaining"))
    return before.join(after, ["dsr_id", "store"], "left").select(
        "dsr_id", "store", "found", "held", F.coalesce("action", F.lit("restrict")).alias("action"),
        F.coalesce("remaining", F.lit(0)).alias("remaining"),
    )


def erasure_status(report: DataFrame) -> DataFrame:
    """Status and evidence digest of each request; there is one report row per store."""
    line = F.concat_ws(":", "store", "found", "held", "action", "remaining")
    return report.groupBy("dsr_id").agg(
        F.sum("found").alias("found"),
        F.when(F.sum("remaining") == F.sum("held"), "completed").otherwise("escalated").alias("status"),
        sha256(F.array_join(F.array_sort(F.collect_list(line)), "\n")).alias("evidence_sha256"),
    )


def restrict(requests: DataFrame, restrictions: DataFrame) -> DataFrame:
    """Add ``refused``: the request carries a restricted subject key.

    ``requests`` holds request_id, subject_key, one row per key.
    """
    blocked = restrictions.select("subject_key", F.lit(True).alias("_r")).distinct()
    return requests.join(blocked, "subject_key", "left").groupBy("request_id").agg(
        F.coalesce(F.bool_or("_r"), F.lit(False)).alias("refused")
    )


def without_restricted(chunks: DataFrame, index: DataFrame, restrictions: DataFrame) -> DataFrame:
    """Chunks retrieval may use once restricted subjects are left out."""
    hit = index.filter("store = 'chunks'").join(restrictions.select("subject_key"), "subject_key", "left_semi")
    return chunks.join(hit.select("location").distinct(), "location", "left_anti")


# --- retention and life cycle ----------------------------------------------------------------

def expired(records: DataFrame, rules: DataFrame, holds: DataFrame, now: Column) -> DataFrame:
    """Records past their retention that no legal hold covers.

    ``rules``: kind, label, months, days, hours, one row per kind and label; without one a record
    is kept.
    ``holds``: scope. A record is held by its own scope.
    """
    kept_until = F.col("ts") + F.make_interval(months="months", days="days", hours="hours")
    due = records.join(rules, ["kind", "label"]).filter(kept_until < now)
    return due.join(holds.select("scope"), "scope", "left_anti").select(*records.columns)


def sweep_report(gone: DataFrame) -> DataFrame:
    return gone.groupBy("kind", "label").agg(F.count(F.lit(1)).alias("deleted"))


def lifecycle(documents: DataFrame, as_of: Column, grace_days: int = 30) -> DataFrame:
    """State of each document on a day, and whether retrieval may use it."""
    until = F.col("certified_until")
    state = (
        F.when(F.col("superseded") | F.coalesce(F.col("valid_until") < as_of, F.lit(False)), "ARCHIVED")
        .when(~F.col("confirmed") | until.isNull(), "AWAITING_LABEL")
        .when(as_of <= until, "CERTIFIED")
        .when(as_of <= F.date_add(until, grace_days), "REVIEW_DUE")
        .otherwise("EXPIRED")
    )
    with_state = documents.withColumn("state", state)
    usable = F.col("state").isin("CERTIFIED", "REVIEW_DUE") | (
        (F.col("state") == "EXPIRED") & F.col("allow_expired")
    )
    return with_state.withColumn("usable", usable)


def table_checks(df: DataFrame, updated_at: str, required: str, unique: list[str], now: Column):
    """Row count, freshness, missing and duplicate checks of a table, as (check, value, ok)."""
    age = F.floor((F.unix_micros(now) - F.unix_micros(F.max(updated_at))) / 3_600_000_000)
    one = df.agg(
        F.count(F.lit(1)).alias("row_count"), age.alias("age_hours"),
        F.count_if(F.col(required).isNull()).alias("missing"),
    )
    repeated = df.groupBy(*unique).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").agg(
        F.coalesce(F.sum("n") - F.count(F.lit(1)), F.lit(0)).alias("value")
    )
    rows = one.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("check"), F.col(c).cast("bigint").alias("value"), ok.alias("ok"))
        for name, c, ok in (
            ("row_count", "row_count", F.col("row_count") > 0),
            ("freshness", "age_hours", F.coalesce(F.col("age_hours") < 24, F.lit(False))),
            ("missing_count", "missing", F.col("missing") == 0),
        )
    ])))
    return rows.unionByName(repeated.select(
        F.lit("duplicate_count").alias("check"), F.col("value").cast("bigint"), (F.col("value") == 0).alias("ok")
    ))


# --- use-case registry -----------------------------------------------------------------------

def key_gate(status: Column, key_kind: Column, label: Column, days_overdue: Column) -> Column:
    """Whether a test or live key of a use case may be used."""
    draft = status.isin("draft", "assessment", "rejected")
    live = key_kind == "live"
    return (
        F.when(status == "retired", "usecase_retired")
        .when(draft & live, "usecase_not_approved")
        .when(draft & (rank(label) > LEVELS.index("internal")), "label_too_high_for_test")
        .when((status == "review") & live & (days_overdue > 14), "review_overdue")
        .when((status == "review") & live, "warn")
        .otherwise("ok")
    )


def major_changes(versions: DataFrame) -> DataFrame:
    """Versions of a use case that need a new review, with the reasons.

    Each version is compared with the last earlier one, whatever numbers lie between.
    """
    compared = ("cloud_models", "max_label", "pii_kinds", "external_tools")
    both = skew.before(versions, ["usecase_id"], ["version"], compared, F.floor(F.col("version") / 1000)).where("before IS NOT NULL")
    old = dict(zip(compared, ("_models", "_label", "_pii", "_tools"), strict=True))
    both = both.select("*", *[F.col(f"before.{c}").alias(a) for c, a in old.items()])

    def added(new: str, before: str) -> Column:
        return F.size(F.array_except(new, before)) > 0

    changes = F.array_compact(F.array(
        F.when(added("cloud_models", "_models"), F.lit("cloud_model_added")),
        F.when(rank(F.col("max_label")) > rank(F.col("_label")), F.lit("label_raised")),
        F.when(added("pii_kinds", "_pii"), F.lit("pii_added")),
        F.when(added("external_tools", "_tools"), F.lit("external_tool_added")),
    ))
    return both.select("usecase_id", "version", changes.alias("changes")).filter(F.size("changes") > 0)


def risk_tier(max_label: Column, pii_tag_: Column, external_users: Column, cloud: Column,
              affects_people: Column, external_action: Column) -> Column:
    """Highest tier any single criterion asks for."""
    high = (rank(max_label) >= LEVELS.index("confidential")) | (pii_tag_ == "pii:sensitive") | affects_people | external_action
    medium = (pii_tag_ == "pii:basic") | external_users | cloud
    return F.when(high, "high").when(medium, "medium").otherwise("low")


def next_review(reviewed: Column, tier: Column) -> Column:
    months = F.when(tier == "high", 3).when(tier == "medium", 6).otherwise(12)
    return F.add_months(reviewed, months)


def processing_records(usecases: DataFrame, usage: DataFrame, catalog: DataFrame) -> DataFrame:
    """Register of processing activities: each use case with its recipients and transfers abroad.

    A recipient the catalog lacks is listed and, its place being unknown, counts as abroad.
    """
    residency = catalog.select(F.col("id").alias("model"), "residency")
    recipients = (
        usage.groupBy("usecase_id", "model").agg(F.count(F.lit(1)).alias("calls"))
        .join(residency, "model", "left")
        .groupBy("usecase_id")
        .agg(F.array_sort(F.collect_set("model")).alias("recipients"),
             F.bool_or(F.coalesce("residency", F.lit("cloud")) == "cloud").alias("abroad"))
    )
    return usecases.join(recipients, "usecase_id", "left").select(
        "usecase_id", "owner", "purposes", "pii_kinds",
        F.coalesce("recipients", F.array().cast("array<string>")).alias("recipients"),
        F.coalesce("abroad", F.lit(False)).alias("abroad"), "review_due",
    )


def cross_border(usage: DataFrame, catalog: DataFrame, registry: DataFrame) -> DataFrame:
    """Cloud use per use case against what the registry declares; either side may be alone.

    A model counts as cloud unless the catalog has it as local.
    """
    local = catalog.filter("residency <> 'cloud'").select(F.col("id").alias("model"))
    used = usage.join(local, "model", "left_anti").groupBy("usecase_id").agg(
        F.count(F.lit(1)).alias("cloud_calls")
    )
    declared = registry.select("usecase_id", "declared_abroad")
    out = used.join(declared, "usecase_id", "full")
    calls = F.coalesce("cloud_calls", F.lit(0))
    verdict = (
        F.when(F.col("declared_abroad").isNull(), "not_registered")
        .when((calls > 0) & ~F.col("declared_abroad"), "undeclared")
        .when((calls == 0) & F.col("declared_abroad"), "unused")
        .otherwise("matches")
    )
    return out.select("usecase_id", calls.alias("cloud_calls"), verdict.alias("verdict"))


def kpi(df: DataFrame, name: str, value: Column) -> DataFrame:
    """One dashboard figure as a row."""
    return df.agg(value.cast("double").alias("value")).select(F.lit(name).alias("kpi"), "value")
