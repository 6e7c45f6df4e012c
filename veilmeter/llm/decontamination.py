"""Benchmark passages in training documents, tolerant of substituted words (operator 1).

Spaced seeds: a mask looks at some words of a span and ignores the others, so a replaced word at an
ignored place does not hide a copy. Masked hashes of the benchmark make a bit table of fixed size; one
pass over the documents keeps only the surroundings of words whose masked hash is in it. Those join
the benchmark's hashes exactly, and each pair of texts is verified around its hits: on the hit's
alignment some ``VERIFY`` words in a row that contain the hit must agree in ``AGREE`` percent.

The masks were chosen by set cover so that every window that agrees in that share holds a hit: all
patterns of replaced words in ``LONGER`` to ``VERIFY`` words (enumerated in the tests). So there
nothing is missed but by inserted or left out words, which end an alignment. Of items of ``SPAN`` to
``LONGER`` - 1 words a part is missed: with one word replaced 2 of 10 places of a 10-word item and none
of an 11-word item, with two 24 of 45 pairs and 7 of 55.

An item shorter than ``VERIFY`` words must agree as a whole in that share; one shorter than ``SPAN``
must occur exactly, and one under ``LEAST`` words is too short to tell and matches nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import BitTable, own, passes, small, written
from .tokens import factor, mix, word_hashes

MASKS = (
    "1101101111", "1111011101", "1010111111", "1111110011", "1001111111", "1111101011", "1011101111",
    "1110111101", "1110011111", "1111101101", "1111111001", "1111110101", "1111001111", "1100111111",
    "1111100111", "1101111101", "1011011111", "1101110111", "1101011111", "1011111101", "1011110111",
)
#: What these leave in items of LONGER words and more.
MORE = ("11110000001111", "11100000110111", "1111101100001")
SPAN, LONGER, VERIFY, AGREE, LEAST = 10, 12, 20, 80, 5
TOGETHER = 1 << 15  # words
BITS = 27  # 16 MB; a benchmark of a million words leaves a few false hits, a larger one more

#: Places each seed looks at; seeds after the masks are whole items of LEAST to SPAN - 1 words.
SEEDS = [tuple(i for i, c in enumerate(m) if c == "1") for m in MASKS + MORE] + [
    tuple(range(n)) for n in range(LEAST, SPAN)
]


def _length(seed: int) -> int:
    return SEEDS[seed][-1] + 1


def seeds_of(length: int) -> list[int]:
    """Seeds of an item of so many words."""
    n, more = len(MASKS), len(MORE)
    if length >= SPAN:
        return [*range(n + more if length >= LONGER else n)]
    return [n + more + length - LEAST] if length >= LEAST else []


def _own(seed: int) -> np.uint64:
    return factor(1000 + seed)


def _hashes(words: np.ndarray, seed: int) -> np.ndarray:
    """Masked hash at every position the seed fits: words are hashes already, so a sum will do."""
    n = len(words) - _length(seed) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, _own(seed))
    for o in SEEDS[seed]:
        total += words[o : o + n] * factor(o)
    return total


def _every_hash(words: np.ndarray, seeds: list[int]):
    """(seed, masked hashes), as ``_hashes``: a mask of few gaps is the sum of its span less those."""
    products = [words * factor(o) for o in range(max((_length(s) for s in seeds), default=0))]
    whole: dict[int, np.ndarray] = {}
    for s in seeds:
        span = _length(s)
        n = len(words) - span + 1
        if n <= 0:
            continue
        if span not in whole:
            whole[span] = sum((products[o][o : o + n] for o in range(1, span)), products[0][:n])
        total = whole[span] + _own(s)
        for o in set(range(span)) - set(SEEDS[s]):
            total -= products[o][o : o + n]
        yield s, total


def _place(keys: np.ndarray, which: int) -> np.ndarray:
    keys = mix(keys, 92) if which else keys
    return (keys >> np.uint64(64 - BITS)).view(np.int64)


def _hits(words: np.ndarray, ends: np.ndarray, used: list[int], table: np.ndarray):
    """Document, place, key and span of the masked hits in texts joined to ``words``, in order."""
    found = []
    for s, h in _every_hash(words, used):
        hit = np.flatnonzero(passes(table, _place(h, 0)))
        key = h[hit]
        sure = passes(table, _place(key, 1))
        hit, key = hit[sure], key[sure]
        doc = np.searchsorted(ends, hit, "right")
        inside = hit + _length(s) <= ends[doc]
        found.append((doc[inside], hit[inside], key[inside], np.full(inside.sum(), _length(s))))
    if not found:
        return [np.zeros(0, np.int64)] * 4
    columns = [np.concatenate(x) for x in zip(*found, strict=True)]
    order = np.argsort(columns[1], kind="stable")
    return [x[order] for x in columns]


def _together(texts, most: int):
    """Lists of texts of about ``most`` words, with their row numbers: short ones share array calls."""
    rows, held = [], 0
    for k, words in enumerate(texts):
        rows.append((k, words))
        held += len(words)
        if held >= most:
            yield rows
            rows, held = [], 0
    if rows:
        yield rows


def _lists(parts, kind) -> pa.Array:
    ends = np.cumsum([0] + [len(p) for p in parts], dtype=np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, kind))


def _item_rows(batches):
    """Words and masked hashes of each benchmark item."""
    for batch in batches:
        tokens, seeds, keys, ats = [], [], [], []
        for words in word_hashes(batch.column("text")):
            n = len(words)
            use = seeds_of(n)
            found = [_hashes(words, s) for s in use]
            tokens.append(words.view(np.int64))
            seeds.append(np.concatenate([np.full(len(f), s, np.int64) for s, f in zip(use, found)] or [np.zeros(0, np.int64)]))
            keys.append(np.concatenate(found or [np.zeros(0, np.uint64)]).view(np.int64))
            ats.append(np.concatenate([np.arange(len(f)) for f in found] or [np.zeros(0, np.int64)]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("item_id").cast(pa.int64()), *[_lists(x, pa.int64()) for x in (tokens, seeds, keys, ats)]],
            names=["item_id", "words", "seeds", "keys", "ats"],
        )


def _key_places(batches):
    for batch in batches:
        key = batch.column("key").to_numpy().view(np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([_place(key, 0), _place(key, 1)]))], names=["place"])


def _regions(table, used: list[int]):
    """Surroundings of masked hits: (doc_id, begin, words, ats, keys), overlapping ones merged."""

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").cast(pa.int64()).to_pylist()
            rows = []
            for group in _together(word_hashes(batch.column("text")), TOGETHER):
                ends = np.cumsum([len(w) for _, w in group])
                docs, places, keys, sizes = _hits(np.concatenate([w for _, w in group]), ends, used, table.value)
                for d in np.unique(docs):
                    k, words = group[d]
                    x, y = np.searchsorted(docs, [d, d + 1])
                    at, key, size = places[x:y] - (ends[d] - len(words)), keys[x:y], sizes[x:y]
                    begin = np.maximum(at + size - VERIFY, 0)
                    end = np.maximum.accumulate(np.minimum(at + VERIFY, len(words)))
                    # Spans differ, so a later hit may need an earlier beginning.
                    begin = np.minimum.accumulate(begin[::-1])[::-1]
                    cuts = np.flatnonzero(np.r_[True, begin[1:] > end[:-1]])
                    for x, y in zip(cuts, np.r_[cuts[1:], len(at)], strict=True):
                        first = int(begin[x])
                        rows.append((ids[k], first, words[first : int(end[y - 1])].view(np.int64), at[x:y], key[x:y].view(np.int64)))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                     *[_lists([r[i] for r in rows], pa.int64()) for i in (2, 3, 4)]],
                    names=["doc_id", "begin", "words", "ats", "keys"],
                )

    return run


def agreement(document: np.ndarray, item: np.ndarray, shift: int, length: int) -> tuple[int, int]:
    """Most equal words of a qualifying window and its place in ``document``; (0, -1) if none.

    ``shift`` is the place of the first word of ``item`` in the document and may be negative; ``item``
    may be a part of an item of ``length`` words.
    """
    lo, hi = max(0, shift), min(len(document), shift + len(item))
    size = min(VERIFY, length)
    if hi - lo < size:
        return 0, -1
    equal = document[lo:hi] == item[lo - shift : hi - shift]
    sums = np.concatenate([[0], np.cumsum(equal)])
    score = sums[size:] - sums[:-size]
    # A window of that many equal words holds a hit, by the choice of the masks.
    good = np.where(100 * score >= (AGREE if length >= SPAN else 100) * size, score, 0)
    best = int(np.argmax(good))
    return (int(good[best]), lo + best) if good[best] else (0, -1)


def _verified(batches):
    for batch in batches:
        region = [np.array(x, np.int64) for x in batch.column("region_words").to_pylist()]
        item = [np.array(x, np.int64) for x in batch.column("item_words").to_pylist()]
        begin = batch.column("begin").to_numpy()
        shift = batch.column("shift").to_numpy() - begin
        length = batch.column("length").to_pylist()
        found = [agreement(r, i, int(s), n) for r, i, s, n in zip(region, item, shift, length, strict=True)]
        keep = pa.array([f[0] > 0 for f in found], pa.bool_())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("item_id"), pa.array([f[0] for f in found], pa.int64()),
             pa.array([int(b) + f[1] for b, f in zip(begin, found, strict=True)], pa.int64())],
            names=["doc_id", "item_id", "equal", "at"],
        ).filter(keep)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_equal, at): documents that hold a passage of a benchmark item.

    n_equal is the largest number of equal words in a verified window, at the least place (in words)
    of a verified window. Null, empty and blank texts match nothing. Equal items and rows with the
    same id each count; rows sharing a doc_id give one row per item, and rows without a doc_id are
    reported under null. Other columns are ignored. Empty tables give no row.
    """
    items = written(
        own(benchmark, "item_id", "text").mapInArrow(
            _item_rows, "item_id bigint, words array<bigint>, seeds array<bigint>, keys array<bigint>, ats array<bigint>"
        ).withColumn("item", F.monotonically_increasing_id())
    )
    keys = written(
        items.select("item", F.explode(F.arrays_zip("seeds", "keys", "ats")).alias("k"))
        .select("item", F.col("k.seeds").alias("seed"), F.col("k.keys").alias("key"), F.col("k.ats").alias("item_at"))
    )
    used = sorted(r["seed"] for r in keys.select("seed").distinct().collect())  # the number of SEEDS at most
    table = BitTable(keys.select("key").mapInArrow(_key_places, "place bigint").distinct(), BITS)
    regions = written(
        own(docs, "doc_id", "text")
        .mapInArrow(
            _regions(table.sent, used),
            "doc_id bigint, begin bigint, words array<bigint>, ats array<bigint>, keys array<bigint>",
        )
        .withColumn("region", F.monotonically_increasing_id()),
        batch_rows=1000,
    )
    hits = regions.select("region", F.explode(F.arrays_zip("ats", "keys")).alias("h")).select(
        "region", F.col("h.ats").alias("at"), F.col("h.keys").alias("key")
    )
    aligned = (
        hits.join(small(keys.drop("seed")), "key")
        .select("region", "item", (F.col("at") - F.col("item_at")).alias("shift"))
        .distinct()
    )
    skipped = F.greatest(F.lit(0), F.col("begin") - F.col("shift"))
    both = (
        aligned.join(regions.select("region", "doc_id", "begin", F.col("words").alias("region_words")), "region")
        .join(items.select("item", "item_id", "words"), "item")
        .select(
            "doc_id", "begin", "region_words", "item_id",
            F.slice("words", (skipped + 1).cast("int"), F.size("region_words")).alias("item_words"),
            (F.col("shift") + skipped).alias("shift"),
            F.size("words").cast("bigint").alias("length"),
        )
    )
    found = both.mapInArrow(_verified, "doc_id bigint, item_id bigint, equal bigint, at bigint")
    return found.groupBy("doc_id", "item_id").agg(F.max("equal").alias("n_equal"), F.min("at").alias("at"))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no benchmark passage was found. Rows without a doc_id stay."""
    leaked = written(leaks(docs, benchmark).where("doc_id is not null").select("doc_id").distinct())
    return docs.join(small(leaked), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
