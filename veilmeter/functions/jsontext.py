"""Questions about JSON text answered with built-in expressions.

Every function first re-writes the JSON through the variant type, which decodes ``\\u`` escapes,
drops blanks and sorts object keys. Escape pairs are then removed, so a string token is plainly
``"[^"]*"`` and no pattern needs a repeated group (Java would recurse on it).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import DEFAULT_MAX_TOKENS, FORBIDDEN_AUDIT_KEYS, TOKEN_FIELDS
from .numbers import read_int
from .text import let


def parsed(json: Column) -> Column:
    return F.try_parse_json(json)


def _bare(compact: Column) -> Column:
    return F.regexp_replace(compact, r"\\.", "_")


def is_object(variant: Column) -> Column:
    return F.startswith(F.schema_of_variant(variant), F.lit("OBJECT"))


def keys_at_any_depth(variant: Column) -> Column:
    """Names of all object keys, nested ones too, without escaped characters."""
    tokens = F.regexp_extract_all(_bare(F.to_json(variant)), F.lit(r'"[^"]*":?'), 0)
    keys = F.filter(tokens, lambda t: F.endswith(t, F.lit(":")))
    return F.transform(keys, lambda t: F.substring(t, 2, F.length(t) - 3))


def holds_content(variant: Column) -> Column:
    """An object key at any depth names request content."""
    return F.exists(
        keys_at_any_depth(variant), lambda k: F.lower(k).isin(*FORBIDDEN_AUDIT_KEYS)
    )


def spaced_length(compact: Column) -> Column:
    """Length of compact JSON once written with a blank after every ``,`` and ``:``."""
    marks = F.regexp_replace(_bare(compact), r'"[^"]*"|[^",:]', "")
    return F.length(compact) + F.length(marks)


def request_tokens(request_json: Column) -> Column:
    """Token estimate of a request: canonical prompt length / 4 rounded up, plus max_tokens."""

    def of(v: Column) -> Column:
        present = F.array_compact(F.array(*[_field_length(v, name) for name in TOKEN_FIELDS]))
        body = F.aggregate(present, F.lit(0), lambda a, n: a + n)
        chars = body + 2 + 2 * F.greatest(F.size(present) - 1, F.lit(0))
        prompt = F.greatest(F.lit(1), F.floor((chars + 3) / 4).cast("int"))
        return prompt + max_tokens(v)

    return let(parsed(request_json), of)


def _field_length(v: Column, name: str) -> Column:
    """Length of ``"name": value``; NULL when the field is missing or null."""
    value = F.to_json(F.try_variant_get(v, f"$.{name}", "variant"))
    return F.when(value != "null", spaced_length(value) + len(name) + 4)


def max_tokens(v: Column) -> Column:
    """Requested completion size: missing, zero or unreadable means the default; never negative."""
    text = F.try_variant_get(v, "$.max_tokens", "string")
    number = F.try_variant_get(v, "$.max_tokens", "double")
    flag = F.schema_of_variant(F.try_variant_get(v, "$.max_tokens", "variant")) == "BOOLEAN"
    quoted = F.schema_of_variant(F.try_variant_get(v, "$.max_tokens", "variant")) == "STRING"
    whole = (
        F.when(flag, F.when(text == "true", 1))
        .when(quoted, read_int(text))
        .when(number != 0, F.when(number > 0, F.floor(number)).otherwise(F.ceil(number)))
    )
    return F.greatest(F.lit(0), F.coalesce(whole, F.lit(DEFAULT_MAX_TOKENS))).cast("bigint")
