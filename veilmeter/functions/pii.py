"""Column functions over one text or one request row: detect, number, redact, restore, mask."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import MASK_OTHER, PII_MODES, PLACEHOLDER
from .spans import DEFAULT_RECOGNISERS, Recogniser, entities, replace_known, rewrite
from .text import digits_only, let

__all__ = [
    "entities", "masked_value", "mask", "numbering", "redact_texts", "request_mapping", "restore",
    "pii_mode", "pii_restore", "placeholder",
]


def placeholder(kind: Column, n: Column) -> Column:
    return F.concat(F.lit("<"), kind, F.lit("_"), n.cast("string"), F.lit(">"))


def masked_value(kind: Column, value: Column) -> Column:
    digits = digits_only(value)
    at = F.instr(value, "@")
    return (
        F.when(
            kind == "EMAIL",
            F.when(
                (at > 0) & (at < F.length(value)),
                F.concat(
                    F.substring(F.substring_index(value, "@", 1), 1, 1),
                    F.lit("***@"),
                    F.substring(value, at + 1, F.length(value)),
                ),
            ).otherwise("***"),
        )
        .when(
            kind.isin("PHONE", "CCCD", "BANK"),
            F.when(F.length(digits) >= 3, F.concat(F.lit("***"), F.substring(digits, -3, 3)))
            .otherwise("***"),
        )
        .when(kind == "ORDER", "#***")
        .otherwise(MASK_OTHER)
    )


def mask(
    text: Column,
    exempt: Column | None = None,
    recognisers: Sequence[Recogniser] = DEFAULT_RECOGNISERS,
) -> Column:
    """Irreversible masking; values in the array ``exempt`` stay visible."""

    def shown(e: Column) -> Column:
        hidden = masked_value(e["kind"], e["value"])
        if exempt is None:
            return hidden
        return F.when(F.array_contains(exempt, e["value"]), e["value"]).otherwise(hidden)

    return let(text, lambda t: let(entities(t, recognisers), lambda es: rewrite(t, es, shown)))


def restore(text: Column, mapping: Column) -> Column:
    """Put originals back; placeholders missing from the mapping stay as they are."""
    return let(text, lambda t: replace_known(t, PLACEHOLDER, mapping))


def numbering(
    found: Column, recognisers: Sequence[Recogniser] = DEFAULT_RECOGNISERS
) -> Column:
    """Distinct values of each kind in order of first appearance, as a map kind -> values."""

    def values_of(kind: str) -> Column:
        of_kind = F.filter(found, lambda e: e["kind"] == kind)
        return F.array_distinct(F.transform(of_kind, lambda e: e["value"]))

    kinds = dict.fromkeys(r.kind for r in recognisers)
    return F.create_map(*[c for kind in kinds for c in (F.lit(kind), values_of(kind))])


def request_mapping(numbers: Column) -> Column:
    """Map placeholder -> original of one request."""
    rows = F.flatten(
        F.transform(
            F.map_entries(numbers),
            lambda kv: F.transform(
                kv["value"], lambda v, i: F.struct(placeholder(kv["key"], i + 1), v)
            ),
        )
    )
    return F.map_from_entries(rows)


def redact_texts(texts: Column, found: Column, numbers: Column) -> Column:
    """Redact all texts of one request row with a shared numbering.

    ``found`` holds the entities of each text, ``numbers`` comes from :func:`numbering`.
    """

    def one(text: Column, spans: Column) -> Column:
        def stand_in(e: Column) -> Column:
            n = F.array_position(F.element_at(numbers, e["kind"]), e["value"])
            return placeholder(e["kind"], n)

        return rewrite(text, spans, stand_in)

    return F.zip_with(texts, found, one)


def pii_mode(raw: Column) -> Column:
    """Configured mode; missing or unknown falls back to the safe one."""
    return F.when(raw.isin(*PII_MODES), raw).otherwise("redact")


def pii_restore(mode: Column, raw: Column) -> Column:
    """Restoring happens in redact mode only, and unless it was switched off.

    ``raw`` is the policy value as text; a missing value means true.
    """
    wanted = F.coalesce(F.lower(raw) == "true", F.lit(True))
    return (mode == "redact") & wanted
