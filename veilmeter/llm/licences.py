"""Licences by recognised sentences and ordered rules (operator 3).

1. A text that matches no part of ``HINT``, as every known sentence does, is left alone; others
   are cut into sentences.
2. A sentence is normalised (lower case, letters, digits and ``.+-`` only, one space between words) and
   mapped to the identifier of a known licence sentence, by expression. Unknown sentences that speak
   of licences become ``?``, all others vanish.
3. The document's identifiers, in order, are matched against the rules in their order. A rule is a
   sequence of identifiers; what it matches is consumed, so that a later and weaker rule (a licence's
   name alone) does not see it again. ``?`` between two identifiers of a rule is skipped and consumed.

An SPDX line names every licence of its expression; the exceptions after WITH are no licences.

Everything happens inside the row, without shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import one_row, own

#: A sentence that speaks of licences.
SPEAKS = "licen[cs]|copyright|permission is hereby|redistribution|spdx|warrant|public domain"
_GAP = "[^a-z0-9.+-]+"
#: Matched by the raw text of every known sentence, however its words are parted, but for AllRights:
#: "all rights reserved" without any word of licences is page furniture (LICENCES_SQL has it so).
HINT = "|".join((
    "licen[cs]|copyright|redistribution|spdx|warrant|cc0", f"permission{_GAP}is{_GAP}hereby",
    f"public{_GAP}domain", f"software{_GAP}is{_GAP}provided", f"neither{_GAP}the{_GAP}name{_GAP}of",
))

# Known sentences of public licences, after normalising. First match wins.
SENTENCES = (
    ("SPDX:$1", r"^spdx-license-identifier ([a-z0-9.+-]+)"),
    ("ApacheName", r"^(this work is |this file is |released |distributed )?(licensed |made available )?under (the )?apache license version 2(\.0)?( the license)?$"),
    ("ApacheComply", r"^you may not use this file except in compliance with the license$"),
    ("ApacheCopy", r"^you may obtain a copy of the license at"),
    ("ApacheLimits", r"^see the license for the specific language governing permissions and limitations"),
    ("MitName", r"^(this (work|file|software) is |released |distributed )?(licensed )?under the mit license$"),
    ("MitGrant", r"^permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("MitNotice", r"^the above copyright notice and this permission notice shall be included in all copies"),
    ("GplName:$1", r"^(?:this (?:work|program|file|software|library) is )?licensed under the gnu general public license version ([123])(?:\.0)?$"),
    ("GplFree", r"^this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("LgplFree", r"^this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("GplEither:$1", r"^either version ([123]) of the license"),
    ("GplHope", r"^this (program|library) is distributed in the hope that it will be useful but without any warranty"),
    ("BsdGrant", r"^redistribution and use in source and binary forms with or without modification are permitted"),
    ("BsdSource", r"^redistributions of source code must retain the above copyright notice"),
    ("BsdBinary", r"^redistributions in binary form must reproduce the above copyright notice"),
    ("BsdNoName", r"^neither the name of .* may be used to endorse or promote products"),
    ("AsIs", r"^(this|the) software is provided (by .* )?as is"),
    ("MplName", r"^this source code form is subject to the terms of the mozilla public license v\. ?2\.0"),
    ("CcName:$1", r"^(?:this (?:work|text|file) is )?licensed under (?:a )?(?:the )?cc ((?:by|by-nc|by-sa|by-nd|by-nc-sa|by-nc-nd) [1-4]\.0)$"),
    ("CcZero", r"^(this work is )?(licensed|released|dedicated) (under|to) (cc0|the public domain)"),
    ("AllRights", r"^(copyright .*)?all rights reserved$"),
    ("Copyright", r"^copyright "),
)
# Identifier sequences to licences, strongest first; an identifier with ``?`` may be missing.
RULES = (
    ("Apache-2.0", "ApacheName ApacheComply? ApacheCopy? ApacheLimits?"),
    ("Apache-2.0", "ApacheComply ApacheCopy ApacheLimits?"),
    ("BSD-3-Clause", "BsdGrant BsdSource BsdBinary BsdNoName AsIs?"),
    ("BSD-2-Clause", "BsdGrant BsdSource BsdBinary AsIs?"),
    ("MIT", "MitGrant MitNotice AsIs?"),
    ("MIT", "MitName"),
    ("LGPL", "LgplFree GplEither:[0-9]? GplHope?"),
    ("GPL", "GplFree GplEither:[0-9]? GplHope?"),
    ("GPL", "GplName:[0-9]"),
    ("MPL-2.0", "MplName"),
    ("CC0-1.0", "CcZero"),
    ("CC", "CcName:[a-z0-9.-]+"),
    ("SPDX", "SPDX:[a-z0-9.+-]+"),
    ("proprietary", "Copyright? AllRights"),
    ("unknown", r"\?"),
)
#: A new line ends a sentence if the next one is empty or starts with a capital.
_BREAK = r"\n([ \t]*[\nA-Z(])"
_CUT = r"\x01|[.;]+[ \t\n]+|[!?]+"
#: An SPDX expression ends with its line.
_SPDX_LINE = r"(?i)(spdx-license-identifier[^\n]*)\n"
_SPDX = r"^spdx-license-identifier ([a-z0-9.+-]+(?: (?:and|or|with) [a-z0-9.+-]+)*)"


def rule_pattern(rule: str, skipped: str = r"(?: \? )*") -> str:
    """Identifiers stand between spaces of their own, so a sequence is a plain concatenation."""
    parts = [(e[:-1], "?") if e.endswith("?") and e != r"\?" else (e, "") for e in rule.split(" ")]
    if not skipped:
        return "".join(f"(?: {name} ){mark}" for name, mark in parts)
    out = ""
    for k, (name, mark) in enumerate(parts):
        if mark and not any(not m for _, m in parts[:k]):
            out += f"(?:(?: {name} ){skipped})?"  # before the first one that may not be missing
        else:
            before = skipped if any(not m for _, m in parts[:k]) else ""
            out += f"(?:{before} {name} ){mark}"
    return out


def normalised(sentence: Column) -> Column:
    plain = F.regexp_replace(F.lower(sentence), "[^a-z0-9.+-]+", " ")
    return F.regexp_replace(plain, "^[ -]+|[ .-]+$", "")


def identifier(sentence: Column) -> Column:
    """Identifier of a normalised sentence, or null."""
    found = F.when(F.rlike(sentence, F.lit(SPEAKS)), F.lit("?"))
    for name, pattern in reversed(SENTENCES):
        value = F.lit(name)
        if name == "SPDX:$1":
            names = F.regexp_replace(F.regexp_extract(sentence, _SPDX, 1), " with [a-z0-9.+-]+", "")
            value = F.concat(F.lit("SPDX:"), F.regexp_replace(names, " (and|or) ", "  SPDX:"))
        elif name.endswith("$1"):
            part = F.translate(F.trim(F.regexp_extract(sentence, pattern, 1)), " ", "-")
            value = F.concat(F.lit(name[:-2]), part)
        found = F.when(F.rlike(sentence, F.lit(pattern)), value).otherwise(found)
    return found


def _after(prefix: str):
    return lambda x: F.concat(F.lit(prefix), x)


def licences(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_sentences (recognised), sentences (identifiers in order), licences.

    ``licences`` lists what the rules found, in rule order, each once; empty if nothing. Null and
    empty texts have none. Repeated rows and null doc_ids are judged like any other row; other
    columns are ignored.
    """
    rows = own(docs, "doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    hinted = F.rlike(F.lower(text), F.lit(HINT))
    lines = F.regexp_replace(F.regexp_replace(text, _SPDX_LINE, "$1\x01"), _BREAK, "\x01$1")
    sentences = F.transform(F.split(lines, _CUT), normalised)
    known = F.filter(F.transform(sentences, identifier), lambda x: x.isNotNull())
    nothing = F.array().cast("array<string>")
    rows = one_row(rows.select("doc_id", "text"), ids=F.when(hinted, known).otherwise(nothing))
    rest = F.concat(F.lit(" "), F.array_join("ids", "  "), F.lit(" "))
    found = []
    for name, rule in RULES:
        pattern = rule_pattern(rule)
        if name in ("CC", "SPDX"):
            prefix = rule.partition(":")[0]
            values = F.regexp_extract_all(rest, F.lit(f" {prefix}:([a-z0-9.+-]+) "), 1)
            found.append(F.transform(values, _after(name + ":")))
        else:
            found.append(F.when(F.rlike(rest, F.lit(pattern)), F.array(F.lit(name))).otherwise(nothing))
        rest = F.regexp_replace(rest, pattern, " / ")
    listed = F.array_join(F.array_distinct(F.concat(*found)), ",")
    return rows.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_sentences"),
        F.replace(F.array_join("ids", " "), F.lit("  "), F.lit(" ")).alias("sentences"),
        F.when(F.size("ids") > 0, listed).otherwise("").alias("licences"),
    )


def _sql() -> str:
    """The same for the given tables: no SPDX expressions, and SPEAKS finds every text that counts."""
    cases = []
    for name, pattern in SENTENCES:
        value = f"'{name}'"
        if name.endswith("$1"):
            value = f"'{name[:-2]}' || translate(trim(regexp_extract(s, '{pattern}', 1)), ' ', '-')"
        cases.append(f"WHEN regexp_matches(s, '{pattern}') THEN {value}")
    steps, found = ["r0 AS (SELECT r, doc_id, ids, ' ' || array_to_string(ids, '  ') || ' ' AS t0 FROM i)"], []
    for k, (name, rule) in enumerate(RULES):
        pattern = rule_pattern(rule, "")
        if name in ("CC", "SPDX"):
            prefix = rule.partition(":")[0]
            hit = f"list_transform(regexp_extract_all(t{k}, ' {prefix}:([a-z0-9.+-]+) ', 1), lambda x: '{name}:' || x)"
        else:
            hit = f"CASE WHEN regexp_matches(t{k}, '{pattern}') THEN ['{name}'] ELSE []::VARCHAR[] END"
        steps.append(f"r{k + 1} AS (SELECT *, {hit} AS f{k}, regexp_replace(t{k}, '{pattern}', ' / ', 'g') AS t{k + 1} FROM r{k})")
        found.append(f"f{k}")
    every = " || ".join(found)
    n = len(RULES)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
x AS (SELECT r, string_split_regex(regexp_replace(t, '{_BREAK}', chr(1) || '\1', 'g'), '{_CUT}') AS l
      FROM d WHERE regexp_matches(lower(t), '{SPEAKS}')),
n AS (SELECT r, k, regexp_replace(regexp_replace(lower(l[k]), '[^a-z0-9.+-]+', ' ', 'g'), '^[ -]+|[ .-]+$', '', 'g') AS s
      FROM (SELECT r, l, unnest(range(1, len(l) + 1)) AS k FROM x)),
c AS (SELECT r, k, CASE {" ".join(cases)} WHEN regexp_matches(s, '{SPEAKS}') THEN '?' END AS id FROM n),
g AS (SELECT r, list(id ORDER BY k) AS ids FROM c WHERE id IS NOT NULL GROUP BY r),
i AS (SELECT r, doc_id, coalesce(ids, []) AS ids FROM d LEFT JOIN g USING (r)),
{", ".join(steps)},
o AS (SELECT r, doc_id, ids, {every} AS e FROM r{n}),
u AS (SELECT r, string_agg(v, ',' ORDER BY p) AS licences FROM (
        SELECT r, v, min(p) AS p FROM (SELECT r, unnest(e) AS v, generate_subscripts(e, 1) AS p FROM o) GROUP BY r, v) GROUP BY r)
SELECT doc_id, len(ids) AS n_sentences, array_to_string(ids, ' ') AS sentences, coalesce(licences, '') AS licences
FROM o LEFT JOIN u USING (r)
"""


LICENCES_SQL = _sql()
