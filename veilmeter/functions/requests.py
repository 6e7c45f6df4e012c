"""Text fields of request and answer bodies given as JSON."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import let

_FIELD = "struct<field:int,part:int,text:string>"
SCANNED_KEYS = ("messages", "system", "content", "text", "input", "prompt")


def _mark(v: Column) -> Column:
    """First character of the value's JSON: its kind."""
    return F.substring(F.to_json(v), 1, 1)


def _string(v: Column) -> Column:
    return F.when(_mark(v) == '"', F.try_variant_get(v, "$", "string"))


def _items(v: Column) -> Column:
    return F.when(_mark(v) == "[", F.try_variant_get(v, "$", "array<variant>"))


def _content(v: Column, field: Column) -> Column:
    """A plain string, or the parts of a list that carry a string ``text``."""

    def part(p: Column, i: Column) -> Column:
        text = F.when(_mark(p) == "{", _string(F.try_variant_get(p, "$.text", "variant")))
        return F.when(
            text.isNotNull(), F.struct(field.alias("field"), i.alias("part"), text.alias("text"))
        )

    plain = F.struct(field.alias("field"), F.lit(0).alias("part"), _string(v).alias("text"))
    parts = F.array_compact(F.transform(_items(v), part))
    return F.coalesce(
        F.when(_string(v).isNotNull(), F.array(plain)).otherwise(parts).cast(f"array<{_FIELD}>"),
        F.array().cast(f"array<{_FIELD}>"),
    )


def request_fields(body: Column) -> Column:
    """Text fields in redaction order: every message's content, then system, input, prompt."""

    def of(v: Column) -> Column:
        messages = F.coalesce(
            _items(F.try_variant_get(v, "$.messages", "variant")),
            F.array().cast("array<variant>"),
        )

        def message(m: Column, i: Column) -> Column:
            inner = F.when(_mark(m) == "{", F.try_variant_get(m, "$.content", "variant"))
            return _content(inner, i)

        tail = [
            _content(F.try_variant_get(v, f"$.{name}", "variant"), F.size(messages) + n)
            for n, name in enumerate(("system", "input", "prompt"))
        ]
        return F.concat(F.flatten(F.transform(messages, message)), *tail)

    return let(F.try_parse_json(body), of)


def _content_places(holder: dict, key: str) -> Iterator[tuple[dict, str]]:
    """Where a content keeps its strings: itself, or the ``text`` of its parts."""
    content = holder[key]
    if isinstance(content, str):
        yield holder, key
    elif isinstance(content, list):
        for part in content:
            if isinstance(part, dict) and isinstance(part.get("text"), str):
                yield part, "text"


def _request_places(body: dict) -> Iterator[tuple[dict, str]]:
    messages = body.get("messages")
    for message in messages if isinstance(messages, list) else []:
        if isinstance(message, dict) and "content" in message:
            yield from _content_places(message, "content")
    for name in ("system", "input", "prompt"):
        if name in body:
            yield from _content_places(body, name)


def _answer_places(body: dict) -> Iterator[tuple[dict, str]]:
    choices = body.get("choices")
    for choice in choices if isinstance(choices, list) else []:
        message = choice.get("message") if isinstance(choice, dict) else None
        if isinstance(message, dict) and isinstance(message.get("content"), str):
            yield message, "content"
    if isinstance(body.get("content"), list):
        yield from _content_places(body, "content")


def _written(places, bodies: pd.Series, texts: pd.Series) -> pd.Series:
    def write(body: str | None, new) -> str | None:
        if body is None or new is None or not len(new):
            return body
        data = json.loads(body)
        for (holder, key), text in zip(places(data), new, strict=True):
            holder[key] = text
        return json.dumps(data, ensure_ascii=False)

    return pd.Series([write(b, t) for b, t in zip(bodies, texts, strict=True)], dtype=object)


@F.pandas_udf(StringType())
def with_request_texts(body: pd.Series, texts: pd.Series) -> pd.Series:
    """The body with the texts of ``request_fields`` replaced, in their order; key order stays."""
    return _written(_request_places, body, texts)


@F.pandas_udf(StringType())
def with_answer_texts(body: pd.Series, texts: pd.Series) -> pd.Series:
    """The body with the texts of ``answer_texts`` replaced, in their order; key order stays."""
    return _written(_answer_places, body, texts)


def answer_texts(body: Column) -> Column:
    """Texts of an answer: ``choices[].message.content``, then ``content[].text``."""

    def of(v: Column) -> Column:
        none = F.array().cast("array<string>")
        choices = F.transform(
            _items(F.try_variant_get(v, "$.choices", "variant")),
            lambda c: F.when(_mark(c) == "{", _string(F.try_variant_get(c, "$.message.content", "variant"))),
        )
        parts = F.transform(
            _items(F.try_variant_get(v, "$.content", "variant")),
            lambda p: F.when(_mark(p) == "{", _string(F.try_variant_get(p, "$.text", "variant"))),
        )
        return F.concat(F.coalesce(F.array_compact(choices), none), F.coalesce(F.array_compact(parts), none))

    return let(F.try_parse_json(body), of)


def untrusted_text(body: Column) -> Column:
    """All caller text of a body, joined by newlines.

    Starting from the body, lists and objects are replaced by their children until only strings
    remain; of an object only the scanned keys count, in a fixed key order.
    """

    def children(v: Column) -> Column:
        nested = F.array(*[F.try_variant_get(v, f"$.{k}", "variant") for k in SCANNED_KEYS])
        return (
            F.when(_mark(v) == "[", _items(v))
            .when(_mark(v) == "{", F.array_compact(nested))
            .when(_mark(v) == '"', F.array(v))
            .otherwise(F.array().cast("array<variant>"))
        )

    def expand(level: Column, _: Column) -> Column:
        open_ = F.exists(level, lambda v: _mark(v) != '"')
        return F.when(open_, F.flatten(F.transform(level, children))).otherwise(level)

    depth = F.length(body) - F.length(F.regexp_replace(body, r"[\[{]", "")) + 1
    start = F.array(F.try_parse_json(body))
    leaves = F.aggregate(F.sequence(F.lit(1), depth), start, expand)
    return F.array_join(F.transform(leaves, lambda v: F.try_variant_get(v, "$", "string")), "\n")
