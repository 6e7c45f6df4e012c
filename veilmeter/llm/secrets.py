"""Secrets in texts, found through an inverted index of trigrams (operator 9).

Each rule's regular expression yields a Boolean query over trigrams that every match must contain,
e.g. ``(pas & ass & ...) | (tok & oke & ken)``. The index holds, for the trigrams of those queries,
the documents that contain them (lower-cased). Postings are intersected per document, and only
documents that satisfy a rule's query are scanned with its expression. A rule without a mandatory
trigram, like runs of hexadecimal digits, scans every text.

All steps are DataFrame functions. Postings are grouped by document, so a trigram that occurs
everywhere is no hot key, and at most the number of indexed trigrams is collected for one document.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from re import _constants as op
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from .shared import one_row, own, small, written


@dataclass(frozen=True)
class Rule:
    """``group`` of a match must have ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
BASE = (
    Rule("assign", rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", "AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", "[0-9a-f]{32,}"),
)
# Fixed public formats of credentials.
MORE = (
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY[A-Z ]*-----"),
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", "AIza[A-Za-z0-9_-]{35,}"),
    Rule("stripe", "[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("bearer", r"[Bb]earer\x20+[A-Za-z0-9._~+/=-]{20,}"),
    Rule("url", r"[a-z][a-z0-9+.-]{1,15}://[^\x00-\x20:/@]+:[^\x00-\x20:/@]+@"),
)
RULES = BASE + MORE

#: A query is a conjunction of clauses; a clause a disjunction of sets of trigrams to be all present.
Query = list[list[frozenset[str]]]
_MOST = 64  # strings a literal part may stand for


def _strings(node) -> set[str] | None:
    """The lower-cased strings one node stands for, or None if they are too many."""
    kind, value = node
    if kind is op.LITERAL:
        return {chr(value).lower()}
    if kind is op.IN:
        if any(k is not op.LITERAL for k, _ in value):
            return None
        return {chr(v).lower() for _, v in value} if len(value) <= 8 else None
    if kind is op.SUBPATTERN:
        return _sequence(value[3])
    if kind is op.BRANCH:
        parts = [_sequence(p) for p in value[1]]
        return None if any(p is None for p in parts) else set().union(*parts)
    if kind is op.MAX_REPEAT and value[1] <= 2:
        once = _sequence(value[2])
        if once is None:
            return None
        every = [{"".join(t) for t in product(once, repeat=n)} for n in range(value[0], value[1] + 1)]
        return set().union(*every)
    return None


def _sequence(nodes) -> set[str] | None:
    every = {""}
    for node in nodes:
        strings = _strings(node)
        if strings is None or len(every) * len(strings) > _MOST:
            return None
        every = {a + b for a in every for b in strings}
    return every


def _clause(strings: set[str]) -> list[frozenset[str]] | None:
    """One of ``strings`` must occur; no clause if one of them is shorter than a trigram."""
    sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
    least = [s for s in sets if not any(o < s for o in sets)]  # a superset adds nothing to a choice
    return sorted(least, key=sorted) if all(sets) else None


def trigram_query(pattern: str) -> Query:
    """Trigrams every match of ``pattern`` contains; empty if none is mandatory."""

    def walk(nodes) -> Query:
        found, run = [], {""}
        for node in [*nodes, None]:
            strings = _strings(node) if node else None
            if strings is not None and len(run) * len(strings) <= _MOST:
                run = {a + b for a in run for b in strings}
                continue
            if clause := _clause(run):
                found.append(clause)
            run = strings if strings is not None else {""}
            if node and strings is None:
                kind, value = node
                if kind is op.SUBPATTERN:
                    found += walk(value[3])
                elif kind is op.MAX_REPEAT and value[0] >= 1:
                    found += walk(value[2])
        return found

    return walk(_parser.parse(pattern))


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """The index: (trigram, doc_id) for the given trigrams and every text that contains them."""
    low = one_row(own(docs, "doc_id", "text"), low=F.lower("text"))
    wanted = F.array(*[F.lit(t) for t in trigrams])
    return low.select(
        F.explode(F.filter(wanted, lambda t: F.contains("low", t))).alias("trigram"), "doc_id"
    )


def satisfied(present: Column, query: Query) -> Column:
    """Whether the trigrams ``present`` fulfil the query."""
    result = F.lit(True)
    for clause in query:
        some = F.lit(False)
        for needed in clause:
            some = some | (F.size(F.array_except(F.array(*map(F.lit, sorted(needed))), present)) == 0)
        result = result & some
    return result


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(doc_id, rules): the rules whose query a document's postings satisfy, as kinds."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    met = [F.when(satisfied(F.col("present"), q), F.lit(k)) for k, q in queries.items() if q]
    return (
        index.groupBy("doc_id")
        .agg(F.collect_set("trigram").alias("present"))
        .select("doc_id", F.array_compact(F.array(*met)).alias("rules"))
        .where(F.size("rules") > 0)
    )


_SPAN = "struct<start:int,rank:int,kind:string,end:int>"
_CHUNK = 256


def _none() -> Column:
    return F.array().cast(f"array<{_SPAN}>")


def _spans(text: Column, rule: Rule, rank: int) -> Column:
    """Leftmost non-overlapping matches that pass, with places in code points."""

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + x["size"]
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), end.alias("end"))
        return F.struct(
            end.alias("at"), F.when(x["ok"], F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out")
        )

    def placed(parts: Column) -> Column:
        # Places run up within chunks from the chunk's offset, so that no array grows beyond a chunk.
        chunks = F.transform(
            F.sequence(F.lit(0), ((F.size(parts) - 1) / _CHUNK).cast("int")),
            lambda k: F.slice(parts, k * _CHUNK + 1, F.lit(_CHUNK)),
        )
        total = lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x["gap"] + x["size"])
        return let(
            chunks,
            lambda cs: let(
                F.transform(cs, total),
                lambda totals: F.flatten(
                    F.transform(
                        cs,
                        lambda c, k: F.aggregate(
                            c,
                            F.struct(
                                F.aggregate(F.slice(totals, F.lit(1), k), F.lit(0), lambda a, x: a + x).alias("at"),
                                _none().alias("out"),
                            ),
                            step,
                            lambda acc: acc["out"],
                        ),
                    )
                ),
            ),
        )

    def located(found: Column) -> Column:
        gaps = F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(found))
        value = lambda m: F.regexp_extract(m, rule.pattern, rule.group) if rule.group else m
        parts = F.zip_with(
            gaps,
            found,
            lambda g, m: F.struct(
                F.length(g).alias("gap"),
                F.length(m).alias("size"),
                (F.length(value(m)) >= rule.least).alias("ok"),
            ),
        )
        return F.when(F.size(found) == 0, _none()).otherwise(let(parts, placed))

    return let(F.regexp_extract_all(text, F.lit(rule.pattern), 0), located)


def _listed(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans, found.

    ``found`` holds the spans as structs (start, rank, kind, end), by start, then rule order. A null
    text counts as empty and has none. Null doc_ids and repeated rows are scanned like any other;
    other columns are ignored; an empty table gives no row.
    """
    rows = own(docs, "doc_id", "text")
    needed = sorted({t for r in rules for clause in trigram_query(r.pattern) for s in clause for t in s})
    picked = written(candidates(postings(rows, needed), rules)).withColumnRenamed("doc_id", "picked_id")
    joined = rows.join(small(picked), rows["doc_id"].eqNullSafe(F.col("picked_id")), "left").withColumn(
        "t", F.coalesce("text", F.lit(""))
    )
    columns = {}
    for rank, rule in enumerate(rules):
        found = _spans(F.col("t"), rule, rank)
        if trigram_query(rule.pattern):
            chosen = F.coalesce(F.array_contains("rules", rule.kind), F.lit(False))
            found = F.when(chosen, found).otherwise(_none())
        columns[f"s{rank}"] = found
    found = one_row(joined, **columns).select("doc_id", *columns)
    base = [f"s{i}" for i, r in enumerate(rules) if r in BASE]
    count = {r.kind: F.size(f"s{i}").cast("bigint") for i, r in enumerate(rules) if r in BASE}
    return one_row(
        found, base=F.array_sort(F.concat(*base)), found=F.array_sort(F.concat(*columns))
    ).select(
        "doc_id",
        *[count.get(r.kind, F.lit(0).cast("bigint")).alias(f"n_{r.kind}") for r in BASE],
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.col("found")).alias("spans"),
        "found",
    )


def _sql() -> str:
    kinds = []
    for rank, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        size = f"length(regexp_extract(m[i], '{p}', {r.group}))" if r.group else "length(m[i])"
        kinds.append(f"""
  SELECT r, {rank} AS rank, '{r.kind}' AS kind, p0 AS s, p0 + length(m[i]) AS e FROM (
    SELECT r, m, i, {size} AS size,
      list_sum(list_transform(g[1:i], lambda x: length(x)))::BIGINT
      + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)::BIGINT AS p0
    FROM (SELECT r, g, m, unnest(range(1, len(m) + 1)) AS i FROM (
      SELECT r, string_split_regex(t, '{p}') AS g, regexp_extract_all(t, '{p}', 0) AS m FROM t) WHERE len(m) > 0)
  ) WHERE size >= {r.least}""")
    base = len(BASE)
    return f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
s AS ({" UNION ALL ".join(kinds)}),
a AS (SELECT r, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access,
        count(*) FILTER (rank = 2) AS n_hex,
        string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank < {base}) AS base,
        string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans
      FROM s GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN a USING (r)
"""


SECRETS_SQL = _sql()
