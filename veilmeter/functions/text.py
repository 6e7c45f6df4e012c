"""Small column helpers shared by the text functions."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import BLANKS, D


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it several times inside ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def computed_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that later filters and projections read but never re-evaluate.

    A one-row ``inline`` stops the optimiser from copying costly expressions into each use.
    """
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select("*", F.inline(F.array(row)))


def strip(text: Column) -> Column:
    """Remove Unicode blanks from both ends."""
    return F.btrim(text, F.lit(BLANKS))


def blank_to_null(text: Column) -> Column:
    return F.nullif(strip(text), F.lit(""))


_ALL_DIGITS = [chr(c) for c in range(128, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Nd"]
_AS_ASCII = "".join(str(unicodedata.digit(c)) for c in _ALL_DIGITS)
_ALL_DIGITS = "".join(_ALL_DIGITS)


def ascii_digits(text: Column) -> Column:
    """Any Unicode decimal digit as its ASCII digit; plain ASCII text is returned untouched."""
    return F.when(text.rlike(r"^[\x00-\x7f]*$"), text).otherwise(
        F.translate(text, _ALL_DIGITS, _AS_ASCII)
    )


def digits_only(text: Column) -> Column:
    return F.regexp_replace(text, f"[^{D}]", "")
