"""Personal data over text tables: find, number, redact, restore, mask, decide, summarise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import LEAK_PHONE, PLACEHOLDER
from ..functions import pii
from ..functions.requests import answer_texts, with_answer_texts
from ..functions.spans import DEFAULT_RECOGNISERS, Recogniser, rewrite
from ..functions.text import computed_once
from ..frames import skew


def detect(
    df: DataFrame, text: str = "text", recognisers: Sequence[Recogniser] = DEFAULT_RECOGNISERS
) -> DataFrame:
    """Add the array ``entities`` found in ``text``."""
    return df.withColumn("entities", pii.entities(F.col(text), recognisers))


def entity_rows(
    df: DataFrame,
    keys: Sequence[str],
    text: str = "text",
    recognisers: Sequence[Recogniser] = DEFAULT_RECOGNISERS,
) -> DataFrame:
    """One row per entity: ``keys``, entity_no, kind, value, start, end."""
    found = computed_once(df.select(*keys, F.col(text).alias("_text")), {
        "_found": pii.entities(F.col("_text"), recognisers)
    })
    rows = found.select(*keys, F.posexplode("_found"))
    return rows.select(
        *keys, F.col("pos").alias("entity_no"), "col.kind", "col.value", "col.start", "col.end"
    )


def number_values(ents: DataFrame, request: str, order: Sequence[str]) -> DataFrame:
    """Placeholder table of each request: (request, kind, n, placeholder, original).

    Repeats collapse in a map-side aggregate; the position among the distinct values is a rank
    that stays exact and spread out when one request is huge.
    """
    first = ents.groupBy(request, "kind", "value").agg(
        F.min(F.struct(*order, "start")).alias("first_seen")
    )
    numbered = skew.running(first, [request, "kind"], ["first_seen"], rank="n")
    return numbered.select(
        request, "kind", "n",
        pii.placeholder(F.col("kind"), F.col("n")).alias("placeholder"),
        F.col("value").alias("original"),
    )


def redact_rows(
    texts: DataFrame,
    ents: DataFrame,
    mapping: DataFrame,
    request: str,
    row: Sequence[str],
    text: str = "text",
) -> DataFrame:
    """Add ``redacted``. Only texts with entities meet their spans; a row's spans fit its text."""
    keys = [request, *row]
    spans = (
        ents.join(
            mapping.select(request, "kind", F.col("original").alias("value"), "placeholder"),
            [request, "kind", "value"],
        )
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("start", "end", "placeholder"))).alias("_spans"))
    )
    none = F.array().cast("array<struct<start:int,end:int,placeholder:string>>")
    return (
        texts.join(spans, keys, "left")
        .withColumn(
            "redacted",
            rewrite(F.col(text), F.coalesce("_spans", none), lambda s: s["placeholder"]),
        )
        .drop("_spans")
    )


def _known_in_text(texts: DataFrame, mapping: DataFrame, request: str, keys: list[str], text: str):
    """Map placeholder -> original for exactly the placeholders each text uses."""
    found = F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(PLACEHOLDER), 0))
    used = computed_once(texts.select(*keys, text), {"_used": found}).select(
        *keys,
        F.explode("_used").alias("placeholder"),
    )
    return (
        used.join(mapping.select(request, "placeholder", "original"), [request, "placeholder"])
        .groupBy(*keys)
        .agg(F.map_from_entries(F.collect_list(F.struct("placeholder", "original"))).alias("_known"))
    )


def restore_rows(
    texts: DataFrame, mapping: DataFrame, request: str, row: Sequence[str], text: str = "text"
) -> DataFrame:
    """Add ``restored``; unknown placeholders stay."""
    keys = [request, *row]
    known = _known_in_text(texts, mapping, request, keys, text)
    empty = F.map_from_entries(F.array().cast("array<struct<placeholder:string,original:string>>"))
    return (
        texts.join(known, keys, "left")
        .withColumn("restored", pii.restore(F.col(text), F.coalesce("_known", empty)))
        .drop("_known")
    )


def respond_rows(
    responses: DataFrame,
    mapping: DataFrame,
    request: str,
    row: Sequence[str],
    text: str = "text",
    recognisers: Sequence[Recogniser] = DEFAULT_RECOGNISERS,
) -> DataFrame:
    """Add ``answer``: off leaves the text alone; otherwise restore if the policy says so, then
    mask personal data that is new, leaving the request's own values visible."""
    keys = [request, *row]
    restored = restore_rows(responses, mapping, request, row, text)
    shown = restored.withColumn(
        "_shown", F.when(F.col("restore"), F.col("restored")).otherwise(F.col(text))
    )
    found = computed_once(
        shown.filter("mode <> 'off'").select(*keys, "restore", "_shown"),
        {"_found": pii.entities(F.col("_shown"), recognisers)},
    ).select(*keys, "restore", F.inline("_found"))
    own = mapping.select(request, F.col("original").alias("value"), F.lit(True).alias("_own"))
    spans = (
        found.join(own.dropDuplicates([request, "value"]), [request, "value"], "left")
        .withColumn(
            "put",
            F.when(F.col("restore") & F.coalesce("_own", F.lit(False)), F.col("value"))
            .otherwise(pii.masked_value(F.col("kind"), F.col("value"))),
        )
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("start", "end", "put"))).alias("_spans"))
    )
    none = F.array().cast("array<struct<start:int,end:int,put:string>>")
    return (
        shown.join(spans, keys, "left")
        .withColumn(
            "answer",
            F.when(F.col("mode") == "off", F.col(text)).otherwise(
                rewrite(F.col("_shown"), F.coalesce("_spans", none), lambda s: s["put"])
            ),
        )
        .drop("_spans", "_shown", "restored")
    )


def respond_bodies(
    bodies: DataFrame,
    mapping: DataFrame,
    request: str,
    row: Sequence[str],
    body: str = "body",
    recognisers: Sequence[Recogniser] = DEFAULT_RECOGNISERS,
) -> DataFrame:
    """Add ``answer_body``: the answer's JSON with every text in it restored and masked as
    ``respond_rows`` does. Both answer shapes are known; a body without texts stays as it is."""
    keys = [request, *row]
    parts = bodies.select(*keys, "mode", "restore", F.posexplode(answer_texts(F.col(body))).alias("_part", "_text"))
    done = respond_rows(parts, mapping, request, [*row, "_part"], "_text", recognisers)
    texts = done.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_part", "answer"))), lambda x: x["answer"]).alias("_texts")
    )
    joined = bodies.join(texts, keys, "left")
    return joined.withColumn("answer_body", with_answer_texts(F.col(body), F.col("_texts"))).drop("_texts")


def action(mode: Column, redactions: Column) -> Column:
    """What happens to a request: masking mode sends placeholders like redact does."""
    return (
        F.when((mode == "off") | (redactions == 0), "pass")
        .when(mode == "block", "block")
        .otherwise("redact")
    )


def decide(requests: DataFrame, mapping: DataFrame, request: str) -> DataFrame:
    """Per request: number of redactions, sorted kinds, action and status code."""
    counted = mapping.groupBy(request).agg(
        F.count(F.lit(1)).alias("redactions"),
        F.array_sort(F.collect_set("kind")).alias("kinds"),
    )
    count = F.coalesce("redactions", F.lit(0))
    empty = F.array().cast("array<string>")
    return (
        requests.join(counted, request, "left")
        .withColumn("redactions", F.when(F.col("mode") == "off", F.lit(0)).otherwise(count))
        .withColumn("kinds", F.when(F.col("redactions") > 0, F.col("kinds")).otherwise(empty))
        .withColumn("action", action(F.col("mode"), F.col("redactions")))
        .withColumn("status", F.when(F.col("action") == "block", 400).otherwise(200))
    )


def leaks(rows: DataFrame, keys: Sequence[str], text: str = "text", redacted: str = "redacted",
          recognisers: Sequence[Recogniser] = DEFAULT_RECOGNISERS) -> DataFrame:
    """Values found in a row's text that its redacted text still shows."""
    shown = F.filter(pii.entities(F.col(text), recognisers), lambda e: F.contains(F.col(redacted), e["value"]))
    found = computed_once(rows.select(*keys, text, redacted), {"_shown": shown})
    return found.select(*keys, F.inline("_shown")).select(*keys, "kind", "value")


def payload_leak(payload: Column) -> Column:
    """A logged payload shows a phone number."""
    return F.rlike(payload, F.lit(LEAK_PHONE))


def corpus_summary(ents: DataFrame, *by: str) -> DataFrame:
    """Entities and distinct values per kind of a corpus.

    Distinct values are counted after collapsing repeats, so a common value stays cheap.
    """
    return (
        ents.groupBy(*by, "kind", "value")
        .agg(F.count(F.lit(1)).alias("_n"))
        .groupBy(*by, "kind")
        .agg(F.sum("_n").alias("entities"), F.count(F.lit(1)).alias("distinct_values"))
    )
