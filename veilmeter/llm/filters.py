"""What each of five filters removes in every order of applying them (operator 13).

The documents become a sparse document-term matrix. A pass cuts the table into shards of about
``SHARD_BYTES`` of text and numbers each shard's own words; the shards' vocabularies make one global
dictionary, which gives every different word a number; each shard then takes its global
numbers and is a CSR matrix (starts, columns, counts) over all words. Its row sums and its numbers
of non-zero cells are the word counts and different words that filters A and B ask for. Filters C
and D are marks of the text, E needs the least id of every different text. Rows are counted by part,
set of failed filters and labels, at most 128 rows a part, and the orders read those counts.

A shuffle moves a word once for each shard that holds it, and never a document's text.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import own, written

FILTERS = "ABCDE"
LEAST_WORDS = 200  # A fails below
LEAST_DISTINCT = 50  # B fails below so many different words in a hundred
MOST_CAPITALS = 3  # C fails above so many capitals in a hundred characters
SYMBOLS = b"#$%&*|"  # D fails with any of them
SHARD_BYTES = 12 << 20
BUCKETS = 1 << 16  # of the dictionary: a task orders the words of one
_PIECE = 1 << 20
_NTH_BITS, _PLACE_BITS = 11, 26  # of a task's shards, and of a shard's words, in a 64-bit number
_CAPITALS = bytes(range(65, 91))
_INSIDE = bytes(range(0x80, 0xC0))  # bytes that begin no character


def _words(text: bytes) -> Counter:
    """Words of one text and how often each occurs; a long text is looked at in pieces."""
    if len(text) <= _PIECE:
        return Counter(text.split())
    found, at, rest = Counter(), 0, b""
    while at < len(text):
        piece = rest + text[at : at + _PIECE]
        at += _PIECE
        words = piece.split()
        # The last word may go on in the next piece.
        rest = words.pop() if at < len(text) and words and not piece[-1:].isspace() else b""
        found.update(words)
    return found


def _marks(text: bytes) -> int:
    """Bits of C and D."""
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    characters = len(text.translate(None, _INSIDE))
    return 4 * (100 * capitals > MOST_CAPITALS * characters) + 8 * (len(text.translate(None, SYMBOLS)) < len(text))


def _packed(values: np.ndarray) -> bytes:
    """32-bit numbers as four byte planes, compressed: what a shard moves and stores is mostly these."""
    planes = np.ascontiguousarray(values, "<i4").view(np.uint8).reshape(-1, 4).T
    return pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, decompressed_size=4 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<i4").ravel()


class _Shard:
    """CSR rows over the shard's own words, until it is full."""

    def __init__(self) -> None:
        self.bytes, self.ids, self.langs, self.digests, self.marks = 0, [], [], [], []
        self.starts, self.places, self.counts, self.words = [0], [], [], {}

    def add(self, doc_id, lang: str | None, text: bytes) -> None:
        row, words = _words(text), self.words
        self.places += [words.setdefault(w, len(words)) for w in row]
        self.counts += row.values()
        self.starts.append(len(self.places))
        self.ids.append(doc_id)
        self.langs.append(lang or "")
        self.digests.append(hashlib.sha256(text).digest())
        self.marks.append(_marks(text))
        self.bytes += len(text) + 64

    def batch(self, number: int, kind: pa.DataType) -> pa.RecordBatch:
        def cell(values, of: pa.DataType) -> pa.Array:
            values = pa.array(values, of)
            return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

        columns = {
            "shard": pa.array([number], pa.int64()), "doc_ids": cell(self.ids, kind), "langs": cell(self.langs, pa.string()),
            "digests": cell(self.digests, pa.binary()), "marks": cell(self.marks, pa.int32()),
            "starts": cell(self.starts, pa.int64()), "places": pa.array([_packed(np.array(self.places, np.int32))], pa.binary()),
            "counts": pa.array([_packed(np.array(self.counts, np.int32))], pa.binary()), "words": cell(list(self.words), pa.binary()),
        }
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _to_shards(size: int):
    def run(batches):
        first, made, shard, kind = TaskContext.get().partitionId() << _NTH_BITS, 0, _Shard(), pa.int64()
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            texts = batch.column("text").cast(pa.large_binary())
            for doc_id, lang, text in zip(batch.column("doc_id").to_pylist(), batch.column("lang").to_pylist(), texts, strict=True):
                shard.add(doc_id, lang, text.as_py() or b"")
                if shard.bytes >= size:
                    yield shard.batch(first + made, kind)
                    made, shard = made + 1, _Shard()
        if shard.ids:
            yield shard.batch(first + made, kind)

    return run


_ROWS = "shard bigint, doc_ids array<{0}>, langs array<string>, digests array<binary>, marks array<int>, starts array<bigint>, "


def _global(shard: pa.Table, known: pa.Table) -> pa.Table:
    """One shard with the dictionary's numbers for its own."""
    numbers = np.empty(known.num_rows, np.int64)
    numbers[known.column("cell").to_numpy() & ((1 << _PLACE_BITS) - 1)] = known.column("word_id").to_numpy()
    n = shard.column("starts")[0].values[-1].as_py()
    offsets = pa.array([0, n], pa.int32())
    cells = {
        "columns": pa.array(numbers[_unpacked(shard.column("places")[0].as_py(), n)]),
        "counts": pa.array(_unpacked(shard.column("counts")[0].as_py(), n)),
    }
    whole = {name: shard.column(name) for name in shard.schema.names if name not in ("places", "counts")}
    return pa.table(whole | {name: pa.ListArray.from_arrays(offsets, c) for name, c in cells.items()})


def matrix(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame]:
    """CSR shards of ``docs`` and the dictionary (word, word_id) of all its words.

    A shard has the ids, languages, text digests and marks of its rows, and starts, columns, counts:
    row i has ``counts[k]`` of word ``columns[k]`` for k from ``starts[i]`` up to ``starts[i + 1]``.
    A shard is a bounded number of bytes; only a text beyond that bound makes a larger one.
    """
    rows = own(docs, "doc_id", "text", "lang")
    head = _ROWS.format(rows.schema["doc_id"].dataType.simpleString())
    shards = written(rows.mapInArrow(_to_shards(shard_bytes), head + "places binary, counts binary, words array<binary>"), 500)
    words = shards.select((F.shiftleft("shard", _PLACE_BITS)).alias("base"), F.posexplode("words").alias("place", "word"))
    words = words.select((F.col("base") + F.col("place")).alias("cell"), "word")
    # A word's number: its rank in the bucket of its hash, the buckets' numbers interleaved.
    bucket = F.pmod(F.xxhash64("word"), F.lit(BUCKETS))
    rank = F.dense_rank().over(Window.partitionBy("bucket").orderBy("word")).cast("bigint")
    known = words.withColumn("bucket", bucket).select("cell", "word", ((rank - 1) * BUCKETS + F.col("bucket")).alias("word_id"))
    dictionary = known.groupBy("word", "word_id").agg(F.count(F.lit(1)).alias("n_shards"))
    csr = shards.drop("words").groupBy("shard").cogroup(known.drop("word").groupBy(F.shiftright("cell", _PLACE_BITS).alias("of")))
    return csr.applyInArrow(_global, head + "columns array<bigint>, counts array<int>"), dictionary


def _row_marks(batches):
    """(doc_id, lang, digest, mask of A to D) of every row of CSR shards."""
    for batch in batches:
        for i in range(batch.num_rows):
            shard = {name: batch.column(name)[i].values for name in batch.schema.names if name != "shard"}
            starts, counts = shard["starts"].to_numpy(), shard["counts"].to_numpy()
            total = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
            words, distinct = np.diff(total[starts]), np.diff(starts)
            mask = (words < LEAST_WORDS) * 1 + (100 * distinct < LEAST_DISTINCT * words) * 2 + shard["marks"].to_numpy()
            yield pa.RecordBatch.from_arrays(
                [shard["doc_ids"], shard["langs"], shard["digests"], pa.array(mask.astype(np.int32)), pa.array(words), pa.array(distinct)],
                names=["doc_id", "lang", "digest", "mask", "n_words", "n_distinct"],
            )


def failures(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, lang, digest, mask, n_words, n_distinct) of every row; ``mask`` has bits 1, 2, 4, 8 for A to D."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shards, _ = matrix(docs, shard_bytes)
    return shards.mapInArrow(
        _row_marks, f"doc_id {kind}, lang string, digest binary, mask int, n_words bigint, n_distinct bigint"
    )


def counted(docs: DataFrame, labels: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(part, mask, n, good, toxic): documents by language and set of failed filters, at most 32 rows a part."""
    rows = written(failures(docs, shard_bytes).select("doc_id", "lang", "digest", "mask"))
    marked = own(labels, "doc_id", "quality", "toxic").where("doc_id is not null").groupBy("doc_id").agg(
        F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("good"),
        F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("toxic"),
    )
    named = rows.where("doc_id is not null").join(marked, "doc_id", "left")
    zero = [F.lit(None).cast("int").alias(c) for c in ("good", "toxic")]
    rows = named.unionByName(rows.where("doc_id is null").select("*", *zero)).fillna(0, ["good", "toxic"])
    # Copies share text, hence mask: only the number of rows with the least id matters.
    like = ["digest", "lang", "mask", "good", "toxic"]
    once = rows.groupBy(*like, "doc_id").agg(F.count(F.lit(1)).alias("n"))
    copies = once.groupBy(*like).agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("n_least"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("n_null"),
    )
    first = copies.groupBy("digest").agg(F.min("least").alias("first"))
    stay = F.when(F.col("least") == F.col("first"), F.col("n_least")).otherwise(0) + F.col("n_null")
    copies = copies.join(first, "digest").select("lang", "mask", "good", "toxic", "n", stay.alias("stay"))
    each = F.explode(F.array(
        F.struct(F.col("mask").alias("m"), F.col("stay").alias("rows")),
        F.struct((F.col("mask") + 16).alias("m"), (F.col("n") - F.col("stay")).alias("rows")),
    ))
    sums = {"n": F.lit(1), "good": F.col("good"), "toxic": F.col("toxic")}
    return (
        copies.select("lang", "good", "toxic", each.alias("e")).where("e.rows > 0")
        .groupBy(F.col("lang").alias("part"), F.col("e.m").alias("mask"))
        .agg(*[F.sum(F.col("e.rows") * c).alias(name) for name, c in sums.items()])
    )


def _steps() -> Column:
    """All 120 orders and their five steps: the filter's bit and the bits before it."""
    steps = []
    for order in permutations(FILTERS):
        before = 0
        for k, name in enumerate(order):
            bit = 1 << FILTERS.index(name)
            steps.append(("".join(order), k + 1, bit, before))
            before |= bit
    names = ("filter_order", "step", "bit", "before")
    rows = ["struct(%s)" % ", ".join(f"{v!r} AS {n}" for v, n in zip(s, names, strict=True)) for s in steps]
    return F.expr(f"array({', '.join(rows)})")


def filter_orders(docs: DataFrame, labels: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Per part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    A part is a language; null counts as the empty string, null text as the empty text (it fails A
    only, and E if a smaller id has it). A row is a document: repeated rows count each, and none of
    them has a smaller id than another. A row with a null doc_id has no smaller id and no label. A
    document labelled twice is good or toxic if one of its labels says so. No documents give no rows.
    """
    counts = written(counted(docs, labels, shard_bytes))
    at = counts.select("*", F.explode(_steps()).alias("s")).select("part", "mask", "n", "good", "toxic", "s.*")
    mask, bit, before = F.col("mask"), F.col("bit"), F.col("before")
    fails, earlier = mask.bitwiseAND(bit) != 0, mask.bitwiseAND(before) != 0

    def total(condition: Column, of: str = "n") -> Column:
        return F.sum(F.when(condition, F.col(of)).otherwise(0))

    steps = at.groupBy("part", "filter_order", "step", "bit").agg(
        total(~fails & ~earlier).alias("kept"), total(fails & ~earlier).alias("removed"), total(fails & earlier).alias("redundant"),
        total(mask == bit).alias("unique_fails"), total(fails & ~earlier, "good").alias("good_lost"),
        total(fails & ~earlier, "toxic").alias("toxic_lost"),
    )
    # 120 rows for a filter of a part.
    return steps.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "bit"))).drop("bit")


_FAILS = """
    SELECT d.doc_id, coalesce(d.lang, '') AS part,
        CASE WHEN len(words) < 200 THEN 1 ELSE 0 END
        + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
        + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 4 ELSE 0 END
        + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
        + CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask
    FROM (SELECT *, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents) d
"""

FILTERS_SQL = f"""
WITH fails AS ({_FAILS}),
marked AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
counts AS (
    SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
    FROM fails LEFT JOIN marked USING (doc_id) GROUP BY 1, 2),
letters(l, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (
    SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
    FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps AS (
    SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INTEGER AS before
    FROM orders, range(1, 6) r(step)),
sums AS (
    SELECT part, filter_order, step, bit,
        sum(CASE WHEN mask & (bit | before) = 0 THEN n ELSE 0 END) AS kept,
        sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS redundant,
        sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost,
        sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
    FROM counts, steps GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
    unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
    (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM sums
"""
