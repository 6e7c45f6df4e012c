"""Find, resolve and rewrite spans of text with built-in expressions only.

For one recogniser, ``split`` yields the text between matches and ``regexp_extract_all`` the
matches; a running length over both gives each value's position in code points. A match is cut into
context and value on its own, so the text is never scanned with groups. A text without a
match costs a single regex pass and no array work.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import PII_PATTERNS, PROVINCE_FIRST, PROVINCE_LAST
from .text import ascii_digits, digits_only, let

_CANDIDATE = "struct<start:int,priority:int,end:int,kind:string,value:string>"
ENTITY = "struct<kind:string,value:string,start:int,end:int>"


@dataclass(frozen=True)
class Recogniser:
    """A kind of value to look for, as parts of a Java pattern without capturing groups.

    ``before`` and ``after`` are look-arounds, ``context`` is matched text in front of the value.
    ``check`` filters found values; ``gate`` is a cheap pattern every text with a match contains.
    """

    kind: str
    value: str
    context: str = ""
    before: str = ""
    after: str = ""
    fold: bool = False
    gate: str | None = None
    check: Callable[[Column], Column] | None = None

    @property
    def _lead(self) -> str:
        return self.before + ("(?iu)" if self.fold else "")

    @property
    def whole(self) -> str:
        """Finds matches. Most texts have none, and groups would slow every position down."""
        return f"{self._lead}{self.context}{self.value}{self.after}"

    @property
    def parts(self) -> str:
        """Cuts one match into context and value; what surrounds it was already checked."""
        flags = "(?iu)" if self.fold else ""
        return rf"\A{flags}({self.context})({self.value})\z"


def province_known(value: Column) -> Column:
    """First three digits name a province code."""
    code = F.substring(ascii_digits(value), 1, 3)
    return code.try_cast("int").between(PROVINCE_FIRST, PROVINCE_LAST)


def account_length(value: Column) -> Column:
    return F.length(digits_only(value)).between(8, 19)


_CHECKS = {"CCCD": province_known, "BANK": account_length}
DEFAULT_RECOGNISERS = tuple(
    Recogniser(kind, check=_CHECKS.get(kind), **parts) for kind, parts in PII_PATTERNS.items()
)


def _none() -> Column:
    return F.array().cast(f"array<{_CANDIDATE}>")


def _candidates(text: Column, r: Recogniser, priority: int) -> Column:
    def located(whole: Column) -> Column:
        def step(acc: Column, s: Column) -> Column:
            context = F.regexp_extract(s["whole"], r.parts, 1) if r.context else F.lit("")
            value = F.regexp_extract(s["whole"], r.parts, 2) if r.context else s["whole"]
            start = acc["at"] + F.length(s["before"]) + F.length(context)
            after = acc["at"] + F.length(s["before"]) + F.length(s["whole"])
            hit = F.struct(
                start.alias("start"),
                F.lit(priority).alias("priority"),
                (start + F.length(value)).alias("end"),
                F.lit(r.kind).alias("kind"),
                value.alias("value"),
            )
            return F.struct(after.alias("at"), F.concat(acc["hits"], F.array(hit)).alias("hits"))

        before = F.slice(F.split(text, r.whole, -1), 1, F.size(whole))
        steps = F.arrays_zip(whole.alias("whole"), before.alias("before"))
        zero = F.struct(F.lit(0).alias("at"), _none().alias("hits"))
        hits = F.aggregate(steps, zero, step, lambda acc: acc["hits"])
        if r.check is not None:
            hits = F.filter(hits, lambda h: r.check(h["value"]))
        return F.when(F.size(whole) == 0, _none()).otherwise(hits)

    found = let(F.regexp_extract_all(text, F.lit(r.whole), 0), located)
    if r.gate:
        literal = r.gate.isascii() and not set(r.gate) & set("\\[](){}.*+?^$|")
        passes = F.contains(text, F.lit(r.gate)) if literal else F.rlike(text, F.lit(r.gate))
        found = F.when(passes, found).otherwise(_none())
    return found


def _without_overlaps(candidates: Column) -> Column:
    """Earliest start first, then recogniser priority; later overlapping spans are dropped."""

    def keep(acc: Column, c: Column) -> Column:
        taken = F.struct(c["end"].alias("until"), F.concat(acc["kept"], F.array(c)).alias("kept"))
        return F.when(c["start"] >= acc["until"], taken).otherwise(acc)

    zero = F.struct(F.lit(-1).alias("until"), _none().alias("kept"))
    kept = F.aggregate(F.array_sort(candidates), zero, keep, lambda acc: acc["kept"])
    return F.when(F.size(candidates) < 2, candidates).otherwise(kept)


def entities(text: Column, recognisers: Sequence[Recogniser] = DEFAULT_RECOGNISERS) -> Column:
    """Non-overlapping entities in order of appearance; NULL text has none."""

    def in_text(t: Column) -> Column:
        every = F.concat(*[_candidates(t, r, i) for i, r in enumerate(recognisers)])
        return F.transform(
            let(every, _without_overlaps),
            lambda c: F.struct(c["kind"], c["value"], c["start"], c["end"]),
        )

    return let(F.coalesce(text, F.lit("")), in_text).cast(f"array<{ENTITY}>")


def rewrite(text: Column, spans: Column, replacement: Callable[[Column], Column]) -> Column:
    """Replace each of the ordered, disjoint ``spans`` of ``text``."""

    def piece(s: Column, i: Column) -> Column:
        begin = F.when(i == 0, F.lit(0)).otherwise(F.get(spans, i - 1)["end"])
        return F.concat(F.substring(text, begin + 1, s["start"] - begin), replacement(s))

    tail = F.substring(text, F.get(spans, F.size(spans) - 1)["end"] + 1, F.length(text))
    rebuilt = F.concat(F.array_join(F.transform(spans, piece), ""), tail)
    return F.when(F.size(spans) == 0, text).otherwise(rebuilt)


def replace_known(text: Column, pattern: str, known: Column) -> Column:
    """Replace every match of ``pattern`` found in the map ``known``; others stay. One pass."""
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    pieces = F.zip_with(
        F.split(text, pattern, -1),
        found,
        lambda before, hit: F.concat(
            before, F.coalesce(F.try_element_at(known, hit), hit, F.lit(""))
        ),
    )
    return F.when(F.size(found) == 0, text).otherwise(F.array_join(pieces, ""))

