"""Strict readings of text fields: numbers, identifiers, times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ascii_digits, let, strip

_INTEGER = r"^[+-]?[0-9]+$"
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_SPECIAL = r"(?i)^[+-]?(nan|inf|infinity)$"
# The usual spelling, which needs no cleaning.
_USUAL = r"^[0-9]{1,18}(\.[0-9]{1,12})?$"
_USUAL_ID = r"^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"


def _clean(text: Column) -> Column:
    return ascii_digits(strip(text))


def read_int(text: Column) -> Column:
    """Whole number in decimal digits, blanks around it allowed; anything else is NULL."""
    t = _clean(text)
    return F.coalesce(text.try_cast("bigint"), F.when(t.rlike(_INTEGER), t.try_cast("bigint")))


def is_number(text: Column) -> Column:
    """Text is a number, an infinity or not-a-number."""
    t = _clean(text)
    return t.rlike(_NUMBER) | t.rlike(_SPECIAL)


def read_double(text: Column) -> Column:
    """Finite floating-point value or NULL."""
    t = _clean(text)
    value = F.when(t.rlike(_NUMBER), t.try_cast("double"))
    unusual = F.when(F.abs(value) < float("inf"), value)
    return F.when(text.rlike(_USUAL), text.try_cast("double")).otherwise(unusual)


def read_decimal(text: Column) -> Column:
    """Finite decimal value or NULL."""
    t = _clean(text)
    unusual = F.when(t.rlike(_NUMBER), t.try_cast("decimal(38,18)"))
    return F.when(text.rlike(_USUAL), text.try_cast("decimal(38,18)")).otherwise(unusual)


def read_uuid(text: Column) -> Column:
    """Canonical lower-case identifier; braces, URN prefix and missing dashes are accepted."""
    bare = F.replace(F.replace(strip(text), F.lit("urn:"), F.lit("")), F.lit("uuid:"), F.lit(""))
    bare = F.replace(F.btrim(bare, F.lit("{}")), F.lit("-"), F.lit(""))
    unusual = let(
        F.lower(bare),
        lambda h: F.when(
            h.rlike("^[0-9a-f]{32}$"),
            F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"),
        ),
    )
    return F.when(text.rlike(_USUAL_ID), text).otherwise(unusual)


def epoch_timestamp(seconds: Column) -> Column:
    """Epoch seconds as a timestamp, the fraction rounded half-even to microseconds."""
    whole = F.floor(seconds)
    micros = F.rint((seconds - whole) * 1e6).cast("bigint")
    return F.timestamp_micros(whole * 1_000_000 + micros)


def epoch_text(micros: Column) -> Column:
    """Microseconds since the epoch as decimal seconds text."""
    whole, rest = F.floor(micros / 1_000_000), F.pmod(micros, F.lit(1_000_000))
    return F.concat(whole.cast("string"), F.lit("."), F.lpad(rest.cast("string"), 6, "0"))


def read_bool(text: Column) -> Column:
    known = F.lower(text).isin("1", "true", "yes") | F.lower(strip(text)).isin("1", "true", "yes")
    return F.coalesce(known, F.lit(False))
