"""Content-free audit events: build, read, append once, count and search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (
    MSG_AUDIT_CONTENT, MSG_AUDIT_JSON, MSG_AUDIT_OBJECT, MSG_AUDIT_TS, MSG_MISSING,
)
from ..functions.crypto import sha256
from ..functions.jsontext import holds_content, is_object, parsed
from ..functions.numbers import epoch_timestamp, read_double
from ..functions.text import blank_to_null, computed_once


def spaced_json(value: Column) -> Column:
    """JSON of a flat struct of numbers, plain names and arrays of names, blanks after marks.

    Only for values without ``,`` or ``:`` inside, such as counts, modes, kinds and rule names.
    """
    return F.regexp_replace(F.to_json(value), "([,:])", "$1 ")


def build_event(
    ts: Column, tenant: Column, action: Column, call_id: Column, team: Column, detail: Column
) -> Column:
    """Audit record as the string map a stream carries. ``detail`` keys must come sorted."""

    def known(c: Column) -> Column:
        return F.coalesce(F.nullif(c, F.lit("")), F.lit("unknown"))

    return F.create_map(
        F.lit("ts"), ts.cast("string"),
        F.lit("actor"), F.concat(F.lit("tenant:"), F.coalesce(tenant, F.lit("unknown"))),
        F.lit("action"), action,
        F.lit("resource"), F.concat(F.lit("request:"), known(call_id)),
        F.lit("team_id"), F.coalesce(team, F.lit("")),
        F.lit("detail"), detail,
    )


def read_audit(records: DataFrame, fields: str = "fields") -> DataFrame:
    """Read string records; ``reason`` holds the first refusal, NULL for a valid event."""

    names = ("detail", "actor", "action", "resource")

    def raw(name: str) -> Column:
        return F.try_element_at(F.col(fields), F.lit(name))

    texts = {
        "_at": read_double(raw("ts")),
        "_detail": blank_to_null(raw("detail")),
        **{n: blank_to_null(raw(n)) for n in names[1:]},
    }
    t = computed_once(computed_once(records, texts), {"_json": parsed(F.col("_detail"))})
    v = computed_once(t, {
        "_object": is_object(F.col("_json")), "_content": holds_content(F.col("_json")),
        "detail": F.to_json(F.col("_json")),
    })
    checks = [
        (F.col("_at").isNull(), MSG_AUDIT_TS),
        (F.col("_detail").isNull(), MSG_MISSING + "detail"),
        (F.col("detail").isNull(), MSG_AUDIT_JSON),
        (~F.col("_object"), MSG_AUDIT_OBJECT),
        (F.col("_content"), MSG_AUDIT_CONTENT),
        *[(F.col(n).isNull(), MSG_MISSING + n) for n in names[1:]],
    ]
    reason = F.coalesce(*[F.when(bad, F.lit(text)) for bad, text in checks])
    return v.select(
        *[F.col(c) for c in records.columns],
        reason.alias("reason"),
        epoch_timestamp(F.col("_at")).alias("ts"),
        "actor", "action", "resource", "detail",
    )


def audit_rows(events: DataFrame) -> DataFrame:
    """Valid events once per stream id, the earliest one."""
    first = F.min(F.struct("ts", "actor", "action", "resource", "detail")).alias("first")
    return events.filter(F.col("reason").isNull()).groupBy("stream_id").agg(first).select("stream_id", "first.*")


def audit_dead_letters(events: DataFrame, fields: str = "fields") -> DataFrame:
    """Refused events; the refused detail is kept as a digest only, because it may hold content."""
    detail = F.try_element_at(F.col(fields), F.lit("detail"))
    rest = F.map_filter(F.col(fields), lambda k, v: k != "detail")
    return events.filter(F.col("reason").isNotNull()).select(
        F.col("stream_id").alias("source_stream_id"),
        "reason",
        rest.alias("fields"),
        sha256(detail).alias("detail_sha256"),
    )


def action_counts(log: DataFrame) -> DataFrame:
    """Guardrail actions per actor and day, one column per action."""
    def n(action: str) -> Column:
        return F.count_if(F.col("action") == f"guardrail.{action}").alias(action)

    return log.groupBy("actor", F.to_date("ts").alias("day")).agg(
        n("pii_blocked"), n("pii_redacted"), n("injection_blocked")
    )


def search(
    log: DataFrame,
    actor: str | None = None,
    action: str | None = None,
    resource: str | None = None,
) -> DataFrame:
    """Rows of the audit log matching every given field."""
    for column, wanted in (("actor", actor), ("action", action), ("resource", resource)):
        if wanted is not None:
            log = log.filter(F.col(column) == wanted)
    return log
