"""How the words of one source differ from those of the others in its language (operator 11).

Terms are counted inside the tasks by packing them: a block of texts becomes arrays of the terms'
places, and terms are parted by length. Up to 8 bytes make one 64-bit word and up to 16 bytes two;
they are put in order by a radix sort of 16-bit digits and counted as runs. Longer terms lie in
buckets of doubling width and are sorted as bytes. The sorts are stable and the last digit is the
(language, source) group, so a run is one term of one group and its documents follow each other: the
runs give the documents of a term, too. Spark then only adds up (language, source, term) rows.

Pairs of sources: a term adds f(p, q) to every pair of its language, but where a source lacks the
term, p is the same for all terms. So only the terms that one of both has are summed, in blocks of
terms dealt out by hash, and the rest is one product. No pair of documents or terms is ever formed.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import own, small, written
from .tokens import texts_of

LEAST_DOCUMENTS = 10  # of a language, for a term to be kept
TOP_TERMS = 10
SCALE, ADDED = 1_000_000_000, 2
BLOCK = 8 << 20  # bytes of text sorted at a time
_ROWS = 50_000  # documents in a block at most: groups are numbered in 16 bits
_ENTRIES = 1 << 15  # (source, term) counts in a block of the pair sums, about; as many as it has pairs, if that is more
_MOST_ENTRIES = 1 << 22
_STRIPE = 512  # sources whose pairs one task sums
_CELLS = 1 << 20

_IN_TERM = np.array([i >= 128 or chr(i).isalpha() for i in range(256)])
_LOWER = np.array([i + 32 if 65 <= i <= 90 else i for i in range(256)], np.uint8)


def radix_order(keys: list[np.ndarray]) -> np.ndarray:
    """Stable order by ``keys``, the least significant first, 16 bits at a time."""
    order = np.arange(len(keys[0]))
    for key in keys:
        for shift in range(0, 8 * key.itemsize, 16):
            digit = ((key >> key.dtype.type(shift)) & key.dtype.type(0xFFFF)).astype(np.uint16)
            if len(digit) and digit.min() < digit.max():
                order = order[np.argsort(digit[order], kind="stable")]  # numpy sorts 16-bit numbers by radix
    return order


def _runs(change: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First place, length and number of documents of every run; ``change`` marks the first places."""
    first = np.flatnonzero(change)
    new = change.copy()
    new[1:] |= doc[1:] != doc[:-1]
    return first, np.diff(np.append(first, len(change))), np.add.reduceat(new.astype(np.int64), first)


def _changes(*sorted_keys: np.ndarray) -> np.ndarray:
    change = np.ones(len(sorted_keys[0]), bool)
    change[1:] = False
    for key in sorted_keys:
        change[1:] |= key[1:] != key[:-1]
    return change


def block_counts(data: np.ndarray, offsets: np.ndarray, group: np.ndarray):
    """(terms, group, count, documents) of the texts ``data[offsets[i]:offsets[i + 1]]`` of ``group[i]``."""
    size = len(data)
    longest = 16
    inside = _IN_TERM[data]
    begins, ends = inside.copy(), np.zeros(size + 1, bool)
    begins[1:] &= ~inside[:-1]
    ends[1:] = inside
    ends[1:-1] &= ~inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < size)]
    begins[cuts] |= inside[cuts]
    ends[cuts] |= inside[cuts - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends)
    if not len(start):
        return
    doc = np.searchsorted(offsets, start, side="right") - 1
    length, group = end - start, group[doc].astype(np.uint16)
    longest = max(longest, 1 << int(length.max() - 1).bit_length())
    padded = np.zeros(size + longest, np.uint8)
    padded[:size] = _LOWER[data]
    eight = np.ndarray((size + 9,), ">u8", padded.data, strides=(1,))  # the 8 bytes from every place on

    def word(at: np.ndarray, n: np.ndarray) -> np.ndarray:
        empty = (8 * (8 - np.minimum(n, 8))).astype(np.uint64)
        return (eight[at].astype(np.uint64) >> empty) << empty

    for low, high in ((0, 8), (8, 16)):
        own = np.flatnonzero((length > low) & (length <= high))
        if not len(own):
            continue
        keys = [word(start[own], length[own])]
        if high == 16:
            keys.insert(0, word(start[own] + 8, length[own] - 8))
        order = radix_order([*keys, group[own]])
        keys, g, d = [k[order] for k in keys], group[own][order], doc[own][order]
        first, n, docs = _runs(_changes(*keys, g), d)
        packed = np.ascontiguousarray(np.stack([k[first] for k in reversed(keys)], axis=1).astype(">u8"))
        yield packed.view(f"S{high}").ravel().tolist(), g[first], n, docs
    width = 32
    while width <= longest:
        own = np.flatnonzero((length > width // 2) & (length <= width))
        if len(own):
            rows = np.lib.stride_tricks.sliding_window_view(padded, width)[start[own]]
            rows[np.arange(width) >= length[own][:, None]] = 0
            rows = rows.view(f"S{width}").ravel()
            order = np.argsort(rows, kind="stable")
            order = order[radix_order([group[own][order]])]
            rows, g, d = rows[order], group[own][order], doc[own][order]
            first, n, docs = _runs(_changes(rows, g), d)
            yield rows[first].tolist(), g[first], n, docs
        width *= 2


def _long_text(data: np.ndarray, size: int):
    """As ``block_counts`` for one text, in pieces cut between terms; only its different terms are held."""
    total: Counter = Counter()
    at = 0
    while at < len(data):
        to = min(at + size, len(data))
        while to < len(data):
            gap = np.flatnonzero(~_IN_TERM[data[max(at, to - size) : to]])
            if len(gap):
                to = max(at, to - size) + int(gap[-1]) + 1
                break
            to = min(to + size, len(data))
        for terms, _, n, _ in block_counts(data[at:to], np.array([0, to - at]), np.zeros(1, np.uint16)):
            for term, k in zip(terms, n.tolist(), strict=True):
                total[term] += k
        at = to
    if total:
        one = np.ones(len(total), np.int64)
        yield list(total), 0 * one, np.fromiter(total.values(), np.int64), one


def _count(size: int):
    def run(batches):
        for batch in batches:
            data, offsets, _ = texts_of(pc.fill_null(batch.column("text"), ""))
            langs, sources = (pc.fill_null(batch.column(c), "").to_pylist() for c in ("lang", "source"))
            row = 0
            while row < batch.num_rows:
                stop = int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1
                stop = min(max(stop, row + 1), batch.num_rows, row + _ROWS)
                known: dict = {}
                group = [known.setdefault(k, len(known)) for k in zip(langs[row:stop], sources[row:stop], strict=True)]
                part = data[offsets[row] : offsets[stop]]
                found = (
                    _long_text(part, size) if len(part) > size
                    else block_counts(part, offsets[row : stop + 1] - offsets[row], np.array(group, np.uint16))
                )
                lang, source = (pa.array([k[i] for k in known], pa.string()) for i in (0, 1))
                for terms, g, n, docs in found:
                    g = pa.array(np.asarray(g, np.int64))
                    yield pa.RecordBatch.from_arrays(
                        [lang.take(g), source.take(g), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())],
                        names=["lang", "source", "term", "n", "docs"],
                    )
                row = stop

    return run


def term_counts(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of every term in a group, and its documents there."""
    found = own(docs, "text", "lang", "source").mapInArrow(
        _count(block), "lang string, source string, term string, n bigint, docs bigint"
    )
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: str, total: str, v: str) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 v)), exact for any count."""
    return F.expr(
        f"CASE WHEN {v} > 0 THEN 1 + (CAST({SCALE} AS DECIMAL(10, 0)) * CAST({n} + {ADDED} AS DECIMAL(19, 0)))"
        f" DIV CAST({total} + {ADDED} * {v} AS DECIMAL(19, 0)) END"
    )


def _gap(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) DIV ({p} + {q})")


def _pair_sums(rows: pa.Table, base: pa.Table) -> pa.Table:
    """For the pairs of one stripe of sources: sum of f over the block's terms that one of both has
    (``value``) and the number of terms that both have (``both``)."""
    at = base.column("nth").to_numpy()
    p0 = np.empty(len(at), np.int64)
    p0[at] = base.column("p0").fill_null(0).to_numpy()
    first = base.column("stripe")[0].as_py() * _STRIPE
    here = min(_STRIPE, len(p0) - first)
    value, both = np.zeros((here, len(p0)), np.int64), np.zeros((here, len(p0)), np.int64)
    if rows.num_rows:
        term = rows.column("term").combine_chunks().dictionary_encode().indices.to_numpy()
        order = np.argsort(term, kind="stable")
        term, source, p = term[order], rows.column("at").to_numpy()[order], rows.column("p").to_numpy()[order]
        begins = np.append(np.flatnonzero(np.append(True, term[1:] != term[:-1])), len(term))
        low = 0
        while low < len(begins) - 1:
            high = max(low + 1, int(np.searchsorted(begins, begins[low] + _CELLS // len(p0), side="right")) - 1)
            cells = slice(begins[low], begins[high])
            t, s, q = term[cells] - term[begins[low]], source[cells], p[cells]
            dense, has = np.repeat(p0[None], high - low, axis=0), np.zeros((high - low, len(p0)), bool)
            dense[t, s], has[t, s] = q, True
            mine = np.flatnonzero((s >= first) & (s < first + here))
            mine = mine[np.argsort(s[mine], kind="stable")]
            if len(mine):
                other = dense[t[mine]]
                f = (q[mine, None] - other) ** 2 // (q[mine, None] + other)
                # Terms that both have come up on either side: they count where the first source is asked.
                twice = has[t[mine]]
                f[twice & (np.arange(len(p0)) < s[mine, None])] = 0
                starts = np.flatnonzero(np.append(True, np.diff(s[mine]) > 0))
                value[s[mine][starts] - first] += np.add.reduceat(f, starts, axis=0)
                both[s[mine][starts] - first] += np.add.reduceat(twice.astype(np.int64), starts, axis=0)
            low = high
    a, b = np.divmod(np.arange(here * len(p0)), len(p0))
    a += first
    keep = a != b
    value, both = value.ravel()[keep], np.where(a < b, both.ravel(), 0)[keep]
    a, b = a[keep], b[keep]
    lang = pa.array([base.column("lang")[0].as_py()] * len(a), pa.string())
    return pa.table({"lang": lang, "a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b)), "value": value, "both": both})


def divergences(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per (lang, source): its distance from every other source of the language, and its ten most
    telling terms, as (lang, source, part, item, value, rank).

    Null text, language or source counts as the empty string. Every row is a document, repeated rows
    too; doc_id and other columns play no part. A group without kept terms has distances, to which a
    term it lacks adds as any other, and no terms. Equal values are ranked by the item's bytes. A
    source alone in its language has no pairs. No documents give no rows.
    """
    counts = written(term_counts(docs, block))
    kept = written(
        counts.groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("docs").alias("docs"))
        .where(F.col("docs") >= LEAST_DOCUMENTS).drop("docs")
    )
    used = written(counts.drop("docs").join(kept, ["lang", "term"]))
    named = docs.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    by_lang = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("n_lang").alias("total_lang"))
    by_group = used.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("entries"))
    groups = named.join(by_group, ["lang", "source"], "left").join(by_lang, "lang", "left")
    groups = groups.fillna(0, ["total", "entries", "v", "total_lang"])
    # Two rows for each source of a language, where the result has a row for each pair of them.
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    whole = Window.partitionBy("lang")
    groups = written(groups.select(
        "*", nth.cast("bigint").alias("nth"), F.count(F.lit(1)).over(whole).alias("sources"),
        F.sum("entries").over(whole).alias("all_entries"),
        _share("0", "total", "v").alias("p0"),
    ).withColumn("blocks", F.expr(
        f"greatest(1, ceil(all_entries / least({_MOST_ENTRIES}, greatest({_ENTRIES}, sources * sources))))"
    )))
    of_group = small(groups.select("lang", "source", F.col("nth").alias("at"), "total", "v", "total_lang", "blocks", "sources"))
    entries = used.join(of_group, ["lang", "source"]).select(
        "lang", "source", "term", "at", "blocks", "sources", _share("n", "total", "v").alias("p"), _share("n_lang", "total_lang", "v").alias("q"),
    )
    stripes = F.explode(F.expr(f"sequence(0, (sources - 1) DIV {_STRIPE})")).alias("stripe")
    dealt = entries.where("sources > 1").select(
        F.col("lang").alias("lang_of"), "term", "at", "p", F.expr("pmod(xxhash64(term), blocks)").alias("block_of"), stripes
    ).withColumnRenamed("stripe", "stripe_of")
    base = groups.where("sources > 1").select("lang", "nth", "p0", "sources", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"))
    base = base.select("lang", "nth", "p0", "block", stripes)
    sums = (
        dealt.groupBy("lang_of", "block_of", "stripe_of").cogroup(base.groupBy("lang", "block", "stripe"))
        .applyInArrow(_pair_sums, "lang string, a bigint, b bigint, value bigint, both bigint")
        .groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("both").alias("both"))
    )
    for end in ("a", "b"):
        side = groups.select("lang", F.col("nth").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in ("source", "entries", "p0")])
        sums = sums.join(small(side), ["lang", end])
    sums = sums.join(small(groups.where("nth = 0").select("lang", "v")), "lang")
    rest = F.expr("v - entries_a - entries_b + both")
    total = F.when(F.col("v") > 0, F.col("value") + rest * _gap("p0_a", "p0_b")).otherwise(0)
    ends = [F.struct(F.col(f"source_{x}").alias("source"), F.col(f"source_{y}").alias("item")) for x, y in ("ab", "ba")]
    pairs = sums.select("lang", total.alias("value"), F.explode(F.array(*ends)).alias("e"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "e.source", F.lit("pair").alias("part"), "e.item", "value").withColumn("rank", F.row_number().over(ranked))
    terms = entries.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _gap("p", "q").alias("value"))
    # Each task passes on its own best ten of a group only.
    terms = terms.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= TOP_TERMS)
    return pairs.unionByName(terms)


DIVERGENCE_SQL = """
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(text, '') AS t, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
tokens AS (
    SELECT d, lang, source, translate(unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM tokens GROUP BY 1, 2 HAVING count(DISTINCT d) >= 10),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY 1),
grouped AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n FROM tokens SEMI JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
totals AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM counts GROUP BY 1, 2),
shares AS (
    SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
        1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(t.total, 0) + 2 * l.v) AS p,
        1 + (1000000000::HUGEINT * (k.n + 2)) // (l.total + 2 * l.v) AS q
    FROM grouped g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN totals t USING (lang, source) LEFT JOIN counts c USING (lang, source, term)),
pairs AS (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
found AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
    FROM grouped a JOIN grouped b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
    UNION ALL
    SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM found)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
