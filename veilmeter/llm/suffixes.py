"""Text that occurs twice anywhere in the corpus, by columns of a collection's transform (operator 12).

A window is a string of ``LENGTH`` bytes. Every byte of a window that starts at two places is removed.

The collection's Burrows-Wheeler transform and common prefixes are built by columns: each round
gives every string of a collection one more symbol on its left, finds the new suffixes' places by
counting that symbol above the old ones, and passes over the transform once, in order. Over whole
documents that takes as many passes as the longest has bytes, over everything; so the collections
are cut to what a window can need, by content, and equal windows always meet:

1. *Sparse anchors.* Of all windows' grams of GRAM bytes, the one of least hash in each window. Where a
   window repeats, so does its anchor. Texts whose anchors occur once are done after this count.
2. *Cores.* Each window left is owned by the place of its least gram of LENGTH - SPAN + 1 bytes, its
   core, which lies in all the SPAN windows around it. A core with at most SPAN - 1 bytes on either
   side is a short string; the core counts as one symbol, so a window is any SPAN symbols that hold
   it, and a string has fewer than 2 * SPAN. Equal strings are one, with their number.
3. *Columns.* Strings that share a core go to blocks of about ``STRINGS``; a block's transform is built in
   fewer than 2 * SPAN rounds. A window repeats where its suffix shares SPAN symbols with a neighbour.
   A core with more strings than a block is dealt out over several; what a block leaves single is
   compared with the other blocks' windows by digest.

Tables between the steps are files in the shared folder, read in order. Exact copies of a text are
one text with a number, and need no windows of their own. Cores, strings and texts are compared as
digests of 128 bits or more; the 64-bit hashes only choose places, so they lose and add nothing.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import BitTable, MarkTable, marked_in, own, passes, place_of, written
from .tokens import _POWERS, mix, texts_of

LENGTH = 400
SPAN = 64  # windows that may share a core; a string has at most 2 * SPAN - 1 symbols, which 8 bits count
GRAM = 320  # bytes of a sparse anchor
STRINGS = 8192  # in a block, about
_BLOCK = 1 << 20  # bytes looked at in one go; places in a block take 20 bits
_TEXT_BITS, _GRAM_BITS = 26, 28


def _pieces(data: np.ndarray, offsets: np.ndarray, length: int):
    """Bytes of about a megabyte with the row and first byte of each part: whole texts together, or
    one piece of a long text. Every window of ``length`` bytes of every text lies in exactly one piece.
    """
    row, rows = 0, len(offsets) - 1
    while row < rows:
        stop = int(np.searchsorted(offsets, offsets[row] + _BLOCK, side="right")) - 1
        if stop > row:
            stop = min(stop, rows)
            yield data[offsets[row] : offsets[stop]], np.arange(row, stop), offsets[row : stop + 1] - offsets[row], np.zeros(stop - row, np.int64)
            row = stop
            continue
        text, step = data[offsets[row] : offsets[row + 1]], _BLOCK - length + 1
        for at in range(0, len(text) - length + 1, step):
            part = text[at : at + _BLOCK]
            yield part, np.array([row]), np.array([0, len(part)]), np.array([at])
        row += 1


def gram_hashes(b: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes from every place on."""
    up, down = _POWERS.upto(len(b))
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
    return mix((sums[size:] - sums[:-size]) * down[: len(b) - size + 1])


def owners(b: np.ndarray, starts: np.ndarray, size: int, length: int, wanted: np.ndarray | None = None):
    """(hash, place, first, last): runs of windows whose gram of least hash, the leftmost of equals, is the
    same. ``starts`` parts the texts; of ``wanted`` windows only, if given."""
    none = np.zeros(0, np.int64)
    if len(b) < length:
        return none.astype(np.uint64), none, none, none
    h = gram_hashes(b, size)
    key = (h & np.uint64(~0xFFFFF & (2**64 - 1))) | np.arange(len(h), dtype=np.uint64)
    grams, reach = length - size + 1, 1
    while 2 * reach <= grams:
        key, reach = np.minimum(key[:-reach], key[reach:]), 2 * reach
    if reach < grams:
        key = np.minimum(key[: len(b) - length + 1], key[grams - reach :])
    place = (key & np.uint64(0xFFFFF)).astype(np.int64)
    valid = np.zeros(len(place) + 1, np.int64)
    long = np.flatnonzero(np.diff(starts) >= length)
    np.add.at(valid, starts[long], 1)
    np.add.at(valid, starts[long + 1] - length + 1, -1)
    valid = np.cumsum(valid[:-1]) > 0
    if wanted is not None:
        valid &= wanted
    at = np.flatnonzero(valid)
    if not len(at):
        return none.astype(np.uint64), none, none, none
    new = np.append(True, (np.diff(at) > 1) | (np.diff(place[at]) != 0))
    first = at[new]
    last = at[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)]
    return h[place[first]], place[first], first, last


def _spread(h: np.ndarray) -> np.ndarray:
    """The same hashes spread evenly: those of anchors are the least of many, so their upper bits are mostly 0."""
    return mix(h, seed=1)


def _texts(batch: pa.RecordBatch, bits: np.ndarray | None, inside: bool) -> pa.RecordBatch:
    """The rows whose digest is, or is not, in the bit table."""
    if bits is None:
        return batch
    hit = passes(bits, batch.column("place").to_numpy())
    return batch.filter(pa.array(hit if inside else ~hit))


def _repeated_texts(sent):
    def run(batches):
        for batch in batches:
            yield _texts(batch, sent.value, True)

    return run


def _sparse(sent, length: int, gram: int):
    def run(batches):
        for batch in batches:
            batch = _texts(batch, sent and sent.value, False)
            data, offsets, _ = texts_of(batch.column("text"))
            for b, _, starts, _ in _pieces(data, offsets, length):
                h, _, _, _ = owners(b, starts, gram, length)
                h, n = np.unique(_spread(h).view(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], names=["gram", "n"])

    return run


_STRING = "c1 bigint, c2 bigint, w1 bigint, w2 bigint"
_PLACED = f"{_STRING}, d1 bigint, d2 bigint, lo bigint, more bigint"
_FLANKS = "w1 bigint, w2 bigint, left binary, right binary"


def _digests(values: list[bytes]) -> np.ndarray:
    """128-bit digests as two columns of numbers."""
    joined = b"".join(hashlib.blake2b(v, digest_size=16).digest() for v in values)
    return np.frombuffer(joined, "<i8").reshape(-1, 2)


def _strings(sent, grams, length: int, span: int, gram: int, flanks=None):
    """Every core's string around the windows whose anchor repeats: digests of core and string, and its text,
    first window and number of further ones; or, where ``flanks`` has its place, what lies beside the core."""
    size = length - span + 1

    def run(batches):
        for batch in batches:
            batch = _texts(batch, sent and sent.value, False)
            data, offsets, _ = texts_of(batch.column("text"))
            d1, d2 = (batch.column(c).to_numpy() for c in ("d1", "d2"))
            for b, rows, starts, base in _pieces(data, offsets, length):
                h, _, first, last = owners(b, starts, gram, length)
                again = marked_in(grams.value, _spread(h))
                if not again.any():
                    continue
                wanted = np.zeros(len(b) - length + 2, np.int64)
                np.add.at(wanted, first[again], 1)
                np.add.at(wanted, last[again] + 1, -1)
                _, place, first, last = owners(b, starts, size, length, np.cumsum(wanted[:-1]) > 0)
                raw = b.tobytes()
                # The string holds the core; where it lies in it is its first byte here.
                whole = _digests([bytes([p - lo]) + raw[lo : hi + length] for p, lo, hi in zip(place.tolist(), first.tolist(), last.tolist(), strict=True)])
                if flanks is not None:
                    hit = np.flatnonzero(marked_in(flanks.value, whole[:, 0].view(np.uint64)))
                    hit = hit[np.unique(whole[hit], axis=0, return_index=True)[1]]
                    left = [raw[first[i] : place[i]] for i in hit.tolist()]
                    right = [raw[place[i] + size : last[i] + length] for i in hit.tolist()]
                    columns = [pa.array(whole[hit, 0]), pa.array(whole[hit, 1]), pa.array(left, pa.binary()), pa.array(right, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["w1", "w2", "left", "right"])
                    continue
                core = _digests([raw[p : p + size] for p in place.tolist()])
                text = np.searchsorted(starts, first, side="right") - 1
                columns = [*core.T, *whole.T, d1[rows[text]], d2[rows[text]], first - starts[text] + base[text], last - first]
                names = [c.split()[0] for c in _PLACED.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c, np.int64)) for c in columns], names=names)

    return run


def _least(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """min(a[low:high]) for many non-empty ranges: by least values of blocks and their doublings."""
    block = 32
    full = a[: len(a) // block * block].reshape(-1, block).min(axis=1) if len(a) >= block else a[:0]
    levels = [full]
    while len(levels[-1]) > 1 << (len(levels) - 1):
        step = 1 << (len(levels) - 1)
        levels.append(np.minimum(levels[-1][:-step], levels[-1][step:]))
    out = np.full(len(low), 127, np.int8)
    lb, rb = -(-low // block), high // block
    inner = np.flatnonzero(rb > lb)
    if len(inner):
        level = np.log2(rb[inner] - lb[inner]).astype(np.int64)
        for k in np.unique(level):
            i = inner[level == k]
            out[i] = np.minimum(levels[k][lb[i]], levels[k][rb[i] - (1 << k)])
    ends = [(low, np.where(rb > lb, lb * block, high)), (np.where(rb > lb, rb * block, high), high)]
    for begin, end in ends:
        i = np.flatnonzero(end > begin)
        i = i[np.argsort(begin[i], kind="stable")]
        if len(i):
            cut = np.stack([begin[i], end[i]], axis=1).ravel()
            out[i] = np.minimum(out[i], np.minimum.reduceat(np.append(a, np.int8(127)), cut)[::2])
    return out


def transform(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, column, common): all suffixes of a collection in order, each with the number of symbols
    it shares with the one before.

    ``symbols`` has a row for each string, -1 before its first and after its last symbol. A round takes
    one column, from the right, and adds one suffix for each string that has a symbol there.
    """
    n, width = symbols.shape
    # Every string's empty suffix comes first. ``first`` is a suffix's own symbol, ``tail`` the place of
    # the suffix behind it: together they are the transform, by place of the symbol.
    string, column = np.arange(n), np.full(n, width)
    first, tail, common = np.full(n, -1, np.int64), np.arange(n), np.zeros(n, np.int8)
    at = np.arange(n)  # of each string's longest suffix so far
    for c in range(width - 1, -1, -1):
        new = np.flatnonzero(symbols[:, c] >= 0)
        if not len(new):
            continue
        x, behind = symbols[new, c], at[new]
        order = np.lexsort([behind, x])
        new, x, behind = new[order], x[order], behind[order]
        # Suffixes are in the order of (symbol, place of the tail): count those before each new one.
        old = np.searchsorted((first << 32) + tail, (x << 32) + behind)
        size = len(first) + len(new)
        to = old + np.arange(len(new))
        rest = np.ones(size, bool)
        rest[to] = False

        def merged(a: np.ndarray, b: np.ndarray, rest=rest, to=to, size=size) -> np.ndarray:
            out = np.empty(size, a.dtype)
            out[rest], out[to] = a, b
            return out

        first, behind = merged(first, x), merged(tail, behind)
        string, column = merged(string, new), merged(column, np.full(len(new), c))
        # A new suffix, and the one after it, share one symbol more with the one before than their tails.
        before, common = common, merged(common, np.zeros(len(new), np.int8))
        ask = np.unique(np.append(to, to + 1))
        ask = ask[(ask > 0) & (ask < size)]
        common[ask] = 0
        ask = ask[(first[ask] == first[ask - 1]) & (first[ask] >= 0)]
        common[ask] = 1 + _least(before, behind[ask - 1] + 1, behind[ask] + 1)
        # Places after the round.
        moved = np.flatnonzero(rest)
        tail = moved[behind]
        at = moved[at]
        at[new] = to
    return string, column, common


def _columns(span: int):
    """Windows of a block's strings that occur twice in it, as offsets ``low`` to ``high``; and for cores dealt
    out over several blocks each different window's digest."""

    def run(table: pa.Table) -> pa.Table:
        n, mid = table.num_rows, span - 1
        left, right = (table.column(c).to_pylist() for c in ("left", "right"))
        symbols = np.full((n, 2 * span - 1), -1, np.int64)
        for i, (a, b) in enumerate(zip(left, right, strict=True)):
            symbols[i, mid - len(a) : mid] = np.frombuffer(a, np.uint8)
            symbols[i, mid + 1 : mid + 1 + len(b)] = np.frombuffer(b, np.uint8)
        cores = np.stack([table.column(c).to_numpy() for c in ("c1", "c2")], axis=1)
        symbols[:, mid] = 256 + np.unique(cores, axis=0, return_inverse=True)[1].ravel()
        string, column, common = transform(symbols)
        length = np.array([len(a) for a in left]), np.array([len(b) for b in right])
        windows = length[0] + length[1] - mid + 1  # of each string
        offset = column - (mid - length[0][string])
        window = (offset >= 0) & (offset < windows[string])
        alike = np.append(common, np.int8(0)) >= span
        twice = window & (alike[:-1] | alike[1:])
        marks = np.zeros((n, span + 1), np.int8)
        marks[string[twice], offset[twice]] = 1
        edges = np.diff(np.pad(marks, ((0, 0), (1, 0))), axis=1)
        who, low = np.nonzero(edges == 1)
        high = np.nonzero(edges == -1)[1] - 1
        w1, w2 = (table.column(c).to_pylist() for c in ("w1", "w2"))
        rows = [(w1[i], w2[i], lo, hi, None) for i, lo, hi in zip(who.tolist(), low.tolist(), high.tolist(), strict=True)]
        # Of equal windows one stands for all.
        parts = table.column("parts").to_numpy()[string] > 1
        for k in np.flatnonzero(window & parts & ~alike[:-1]).tolist():
            i, o = int(string[k]), int(offset[k])
            a = left[i][o:]
            text = cores[i].tobytes() + bytes([len(a)]) + a + right[i][: mid - len(a)]
            rows.append((w1[i], w2[i], o, o, hashlib.blake2b(text, digest_size=16).digest()))
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        names = ["w1", "w2", "low", "high", "window"]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return run


def _removed(length: int):
    """Cut the merged spans out of the texts."""

    def run(batches):
        for batch in batches:
            out = []
            texts = batch.column("text").cast(pa.large_binary())
            for d1, d2, text, spans in zip(batch.column("d1").to_pylist(), batch.column("d2").to_pylist(), texts, batch.column("spans"), strict=True):
                spans = spans.values
                low, high = (spans.field(i).to_numpy() for i in (0, 1))
                order = np.argsort(low, kind="stable")
                low, high = low[order], np.maximum.accumulate(high[order]) + length
                new = np.append(True, low[1:] > high[:-1])
                begin, end = low[new], high[np.append(np.flatnonzero(new)[1:] - 1, len(low) - 1)]
                text, kept, at = text.as_py(), hashlib.sha256(), 0
                for b, e in zip(begin.tolist(), end.tolist(), strict=True):
                    kept.update(text[at:b])
                    at = e
                kept.update(text[at:])
                out.append((d1, d2, int((end - begin).sum()), kept.hexdigest(), begin.tolist(), end.tolist()))
            names, many = ["d1", "d2", "n_removed", "kept_sha256", "begins", "ends"], pa.list_(pa.int64())
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), many, many]
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return run


def repeats(docs: DataFrame, length: int = LENGTH, span: int = SPAN, gram: int = GRAM, strings: int = STRINGS) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and begins and ends of the removed runs.

    Null text counts as empty; texts shorter than ``length`` lose nothing. Every row is a document, so
    rows with equal texts of ``length`` bytes or more lose everything, whatever their doc_id. A null
    doc_id stays null; other columns play no part. Both grams must fit a window: ``span`` and ``gram``
    below ``length``, and ``span`` is 64 at most.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id"), text.alias("text"))
    sha = F.sha2("text", 256)
    # A text is known by 120 bits of its digest, as two numbers.
    key = [F.conv(F.substring(sha, i, 15), 16, 10).cast("bigint").alias(c) for i, c in ((1, "d1"), (16, "d2"))]
    sized = rows.select("doc_id", "text", F.octet_length("text").cast("bigint").alias("n_bytes"), sha.alias("sha"), *key)
    every = written(sized.drop("text"))
    copies = every.where(F.col("n_bytes") >= length).groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n"))
    copies = written(copies.where("n > 1").select("d1", "d2"))

    def text_bits(df: DataFrame):
        return BitTable(df.select(place_of(F.col("d1"), _TEXT_BITS)), _TEXT_BITS).sent

    seen = text_bits(copies)
    # Texts that surely occur once are read where they lie; of the others one copy is written.
    long = sized.where(F.col("n_bytes") >= length).select("d1", "d2", "text", place_of(F.col("d1"), _TEXT_BITS).alias("place"))
    once = written(
        long.mapInArrow(_repeated_texts(seen), long.schema).groupBy("d1", "d2").agg(F.first("text").alias("text"), F.first("place").alias("place"))
    )

    def over(function, schema: str) -> DataFrame:
        return long.mapInArrow(function(seen), schema).unionByName(once.mapInArrow(function(None), schema))

    grams = over(lambda sent: _sparse(sent, length, gram), "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    bits = MarkTable(grams.where("n > 1").select("gram"), _GRAM_BITS).sent
    found = written(over(lambda sent: _strings(sent, bits, length, span, gram), _PLACED))
    string, one_of = ["c1", "c2", "w1", "w2"], ["d1", "d2", "lo"]
    # The place is read of strings that occur once only, where all least values are of one row.
    one = written(found.groupBy(*string).agg(F.count(F.lit(1)).alias("n"), *[F.min(c).alias(c) for c in one_of]))
    shared = one.groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("strings"), F.min("n").alias("least")).where("strings > 1 AND least = 1")
    shared = shared.select("c1", "c2", F.ceil(F.col("strings") / strings).cast("int").alias("parts"))
    asked = written(one.join(shared, ["c1", "c2"]).select(*string, "parts", F.pmod(F.xxhash64("w1"), "parts").alias("part")))
    blocks = max(1, -(-asked.count() // strings))
    beside = over(lambda sent, at=MarkTable(asked.select("w1"), _GRAM_BITS).sent: _strings(sent, bits, length, span, gram, at), _FLANKS)
    beside = beside.groupBy("w1", "w2").agg(F.first("left").alias("left"), F.first("right").alias("right"))
    dealt = asked.join(beside, ["w1", "w2"]).withColumn("block", F.pmod(F.xxhash64("c1", "c2", "part"), F.lit(blocks)))
    marked = written(dealt.groupBy("block").applyInArrow(_columns(span), "w1 bigint, w2 bigint, low int, high int, window binary"))
    between = marked.where("window IS NOT NULL")
    met = between.groupBy("window").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("window")
    marked = marked.where("window IS NULL").unionByName(between.join(met, "window", "left_semi"))
    single = one.where("n = 1").select("w1", "w2", *one_of)
    ranges = marked.join(single, ["w1", "w2"]).select("d1", "d2", (F.col("lo") + F.col("low")).alias("low"), (F.col("lo") + F.col("high")).alias("high"))
    again = found.join(one.where("n > 1").select("w1", "w2"), ["w1", "w2"], "left_semi")
    ranges = ranges.unionByName(again.select("d1", "d2", F.col("lo").alias("low"), (F.col("lo") + F.col("more")).alias("high")))
    ranges = ranges.join(copies, ["d1", "d2"], "left_anti")
    spans = written(ranges.groupBy("d1", "d2").agg(F.collect_list(F.struct("low", "high")).alias("spans")))
    touched = long.mapInArrow(_repeated_texts(text_bits(spans)), long.schema).drop("place").join(spans, ["d1", "d2"])
    done = written(
        touched.mapInArrow(_removed(length), "d1 bigint, d2 bigint, n_removed bigint, kept_sha256 string, begins array<bigint>, ends array<bigint>")
    )
    everything = every.join(copies.withColumn("copied", F.lit(True)), ["d1", "d2"], "left").join(done, ["d1", "d2"], "left")
    copied = F.coalesce(F.col("copied"), F.lit(False))
    begins = F.when(copied, F.array(F.lit(0).cast("bigint"))).otherwise(F.coalesce("begins", F.array().cast("array<bigint>")))
    ends = F.when(copied, F.array("n_bytes")).otherwise(F.coalesce("ends", F.array().cast("array<bigint>")))
    kept = F.when(copied, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha"))
    return everything.select(
        "doc_id", "n_bytes", F.when(copied, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.size(begins).cast("bigint").alias("n_spans"), kept.alias("kept_sha256"), begins.alias("begins"), ends.alias("ends"),
    )


REPEATS_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS d, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS (
    SELECT d, s, md5(substring(h, 2 * s + 1, {2 * LENGTH})) AS k
    FROM (SELECT d, h, unnest(range(0, len(h) // 2 - {LENGTH - 1})) AS s FROM docs WHERE len(h) >= {2 * LENGTH})),
twice AS (SELECT k FROM windows GROUP BY 1 HAVING count(*) > 1),
marked AS (SELECT d, s, lag(s) OVER (PARTITION BY d ORDER BY s) AS before FROM windows SEMI JOIN twice USING (k)),
numbered AS (
    SELECT d, s, sum(CASE WHEN before IS NULL OR s > before + {LENGTH} THEN 1 ELSE 0 END) OVER (PARTITION BY d ORDER BY s) AS run FROM marked),
runs AS (SELECT d, run, min(s) AS b, max(s) + {LENGTH} AS e FROM numbered GROUP BY 1, 2),
pieces AS (SELECT d, b, e, coalesce(lag(e) OVER (PARTITION BY d ORDER BY b), 0) AS prior FROM runs),
cut AS (
    SELECT d, sum(e - b) AS n_removed, count(*) AS n_spans, max(e) AS last,
        string_agg(substring(h, (2 * prior + 1)::BIGINT, (2 * (b - prior))::BIGINT), '' ORDER BY b) AS kept
    FROM pieces JOIN docs USING (d) GROUP BY d)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
    sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE kept || substring(h, (2 * last + 1)::BIGINT) END)) AS kept_sha256
FROM docs LEFT JOIN cut USING (d)
"""
