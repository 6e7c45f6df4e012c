"""The guardrail chain as one stateless job: every request is decided inside its own row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import injection, pii
from ..functions.numbers import epoch_text
from ..functions.requests import request_fields, untrusted_text, with_request_texts
from ..functions.spans import DEFAULT_RECOGNISERS, ENTITY, Recogniser
from ..functions.text import computed_once
from ..operators.audit import build_event, spaced_json
from ..operators.pii import action
from .ingest import batch_folder


def guard(requests: DataFrame, recognisers: Sequence[Recogniser] = DEFAULT_RECOGNISERS) -> DataFrame:
    """Redact, block or pass requests: request_id, ts, tenant, body (JSON), raw_mode, raw_restore,
    injection_mode.

    Personal data comes first; injection rules then see all untrusted text of the redacted body, also
    what is nested in tool results and lists; a request blocked for personal data is not scanned. The
    body comes back redacted, and null where the request is blocked. Adds ``redacted`` (the text
    fields), ``mapping`` (kept only when it will be restored), ``redactions``, ``kinds``, ``rules``,
    ``action`` and ``audit``.
    """
    mode = pii.pii_mode(F.col("raw_mode"))
    fields = computed_once(requests, {
        "fields": request_fields(F.col("body")), "mode": mode,
        "restore": pii.pii_restore(mode, F.col("raw_restore")),
    })
    texts = F.transform("fields", lambda f: f["text"])
    nothing = F.array().cast(f"array<{ENTITY}>")
    found = computed_once(fields, {
        "_found": F.transform(
            texts, lambda t: F.when(F.col("mode") == "off", nothing).otherwise(pii.entities(t, recognisers))
        ),
    })
    numbered = computed_once(found, {"_numbers": pii.numbering(F.flatten("_found"))})
    redacted = computed_once(numbered, {
        "_texts": pii.redact_texts(texts, F.col("_found"), F.col("_numbers")),
        "mapping": pii.request_mapping(F.col("_numbers")),
    })
    counted = computed_once(redacted, {
        "redactions": F.size("mapping"),
        "kinds": F.array_sort(F.map_keys(F.map_filter("_numbers", lambda k, v: F.size(v) > 0))),
        "_pii": action(F.col("mode"), F.size("mapping")),
    })
    scanning = (F.coalesce(F.lower("injection_mode"), F.lit("block")) == "block") & (F.col("_pii") != "block")
    rewritten = F.when(F.col("redactions") > 0, F.col("_texts"))
    counted = computed_once(counted, {"_body": with_request_texts("body", rewritten)})
    scanned = computed_once(counted, {
        "rules": F.when(scanning, injection.rules(untrusted_text(F.col("_body"))))
        .otherwise(F.array().cast("array<string>")),
    })
    final = F.when(F.size("rules") > 0, "block").otherwise(F.col("_pii"))
    seconds = epoch_text(F.unix_micros("ts"))
    call = F.col("request_id").cast("string")

    def event(name: str, detail):
        return build_event(seconds, F.col("tenant"), F.lit(f"guardrail.{name}"), call,
                           F.lit(None).cast("string"), spaced_json(detail))

    count = F.col("redactions").alias("count")
    audit = F.array_compact(F.array(
        F.when(F.col("_pii") == "block", event("pii_blocked", F.struct(count, "kinds"))),
        F.when(F.col("_pii") == "redact", event("pii_redacted", F.struct(count, "mode"))),
        F.when(F.size("rules") > 0, event("injection_blocked", F.struct("rules"))),
    ))
    kept = F.map_filter("mapping", lambda k, v: F.col("restore"))
    rebuilt = F.zip_with("fields", "_texts", lambda f, t: F.struct(
        f["field"].alias("field"), f["part"].alias("part"), t.alias("text")
    ))
    return scanned.select(
        *[F.col(c) for c in requests.columns if c != "body"],
        F.when(final != "block", F.col("_body")).alias("body"), "mode", "restore", rebuilt.alias("redacted"), kept.alias("mapping"), "redactions", "kinds",
        "rules", final.alias("action"), audit.alias("audit"),
    )


def write_outcomes(path: str):
    """Sink function: passed requests without raw text, blocked ones without any, and audit events."""

    def store(batch: DataFrame, batch_id: int) -> None:
        done = guard(batch).persist()

        def put(df: DataFrame, name: str) -> None:
            df.write.mode("overwrite").parquet(batch_folder(batch, f"{path}/{name}", batch_id))

        put(done.filter("action <> 'block'").drop("audit", "rules", "kinds", "mapping"), "passed")
        put(done.filter("action = 'block'").select("request_id", "ts", "tenant", "redactions", "kinds", "rules"),
            "blocked")
        put(done.select("request_id", F.posexplode("audit").alias("n", "fields")).select(
            F.concat_ws("-", F.col("request_id").cast("string"), F.col("n").cast("string")).alias("stream_id"),
            "fields"), "audit")
        done.unpersist()

    return store
