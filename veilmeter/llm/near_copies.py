"""Near-duplicate documents: fast similarity sketches, banding, exact check (operator 7).

1. One pass makes a document's set (distinct five-word shingles as 64-bit hashes), a 128-bit
   fingerprint of the set and a sketch of ``BINS`` coordinates. Round i of the sketch throws every
   shingle into a random bin; an empty bin keeps the least value of the first round that reaches it,
   and rounds from ``BINS`` on fill one given bin each, so every coordinate is filled. Two sets agree
   in a coordinate with probability equal to their similarity, concentrated as for independent
   coordinates or better.
2. Equal sets collapse to the smallest doc_id.
3. ``ROWS`` coordinates make a band; equal bands meet in a bucket. Two sets of similarity 0.75 share
   none of the ``BANDS`` buckets with probability 2e-5.
4. Every member of a bucket is compared with the bucket's smallest member: linear in the members,
   also in a huge group of near copies.
5. Where a bucket then still holds several components, a node next to a component of ``BIG`` nodes is
   compared with all of that component on the full sets, in blocks. The other nodes of the bucket
   meet in blocks of ``BLOCK``: numpy counts equal coordinates, and only pairs of different
   components, of fitting sizes and with at least ``AGREE`` of the coordinates equal leave a block (a
   pair of similarity 0.75 is above that but for 2e-5), in its first common bucket only.
6. All pairs are confirmed on the full sets, links are merged into components.

No bucket has a cap. What is quadratic is what stays outside a bucket's main component, and only
inside numpy blocks spread over tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import BitTable, components, own, passes, place_of, small, written
from .tokens import mix, windows, word_hashes

SHINGLE = 5
SIMILAR = 75  # percent
ROWS, BANDS = 5, 40
BINS = ROWS * BANDS
AGREE = 0.62
BLOCK, BIG, CHUNK = 256, 64, 1024
NODE_BITS = 24  # of the table that picks the documents whose sets are needed: 2 MB
_NONE = np.uint64(2**64 - 1)
_SETS = "node bigint, p1 bigint, shingles array<bigint>, coordinates binary, keys array<bigint>"


def sketch(shingles: np.ndarray) -> np.ndarray:
    """``BINS`` coordinates of a non-empty set."""
    out = np.zeros(BINS, np.uint64)
    open_ = np.ones(BINS, bool)
    for i in range(2 * BINS):
        value = mix(shingles, i + 1)
        least = np.full(BINS, _NONE)
        if i < BINS:
            bins = ((value >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)
            np.minimum.at(least, bins.astype(np.int64), value)
        else:
            least[i - BINS] = value.min()
        new = open_ & (least != _NONE)
        out[new] = mix(least[new], i)
        open_ &= ~new
        if not open_.any():
            break
    return out


def band_keys(coordinates: np.ndarray) -> np.ndarray:
    key = np.arange(BANDS, dtype=np.uint64)
    for column in coordinates.reshape(BANDS, ROWS).T:
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + column)
    return key.view(np.int64)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0] + [len(p) for p in parts], dtype=np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int64()))


def _sets(column: pa.Array):
    for words in word_hashes(column):
        yield np.unique(windows(words, SHINGLE))


def _print(s: np.ndarray, seed: int) -> int | None:
    return int(mix(s, seed).sum().view(np.int64)) if len(s) else None


def _prints(batches):
    """Size, fingerprint and band keys of each text; an empty set has no fingerprint and no keys."""
    for batch in batches:
        sizes, one, two, keys = [], [], [], []
        for s in _sets(batch.column("text")):
            sizes.append(len(s))
            one.append(_print(s, 7001))
            two.append(_print(s, 7002))
            keys.append(band_keys(sketch(s)) if len(s) else np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(one, pa.int64()),
             pa.array(two, pa.int64()), _lists(keys)],
            names=["doc_id", "n_shingles", "p1", "p2", "keys"],
        )


def _chosen_sets(table):
    """Sets, sketches and band keys of the rows whose place is in the filter."""

    def run(batches):
        for batch in batches:
            batch = batch.filter(pa.array(passes(table.value, batch.column("place").to_numpy())))
            if not batch.num_rows:
                continue
            sets = list(_sets(batch.column("text")))
            coordinates = [sketch(s) if len(s) else np.zeros(BINS, np.uint64) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array([_print(s, 7001) for s in sets], pa.int64()),
                 _lists([s.view(np.int64) for s in sets]),
                 pa.array([c.astype(np.uint16).tobytes() for c in coordinates], pa.binary()),
                 _lists([band_keys(c) for c in coordinates])],
                names=["node", "p1", "shingles", "coordinates", "keys"],
            )

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""

    def run(batches):
        for batch in batches:
            left, right = batch.column("left"), batch.column("right")
            keep = []
            lv, rv = left.flatten().to_numpy(), right.flatten().to_numpy()
            lo, ro = np.cumsum([0, *left.value_lengths().to_pylist()]), np.cumsum([0, *right.value_lengths().to_pylist()])
            for i in range(batch.num_rows):
                x, y = lv[lo[i] : lo[i + 1]], rv[ro[i] : ro[i + 1]]
                if 100 * min(len(x), len(y)) < SIMILAR * max(len(x), len(y)):
                    keep.append(False)
                    continue
                both = np.concatenate([x, y])
                both.sort()
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * common >= SIMILAR * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    with_b = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("right")), "b")
    with_both = with_b.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("left")), "a")
    return with_both.select("a", "b", "left", "right").mapInArrow(run, "a bigint, b bigint")


def _met(rows: list[tuple]) -> list[tuple[int, int]]:
    """Candidate pairs of one block pair: rows are (side, node, component, size, band, coordinates, keys)."""
    side = np.array([r[0] for r in rows])
    node = np.array([r[1] for r in rows], np.int64)
    component = np.array([r[2] for r in rows], np.int64)
    size = np.array([r[3] for r in rows], np.int64)
    coordinates = np.stack([np.frombuffer(r[5], np.uint16) for r in rows])
    keys = np.stack([r[6] for r in rows])
    band = rows[0][4]
    left, right = np.flatnonzero(side <= 1), np.flatnonzero(side != 1)
    within = (side == 0).all()  # a block with itself
    out = []
    for i in left:
        other = right[(component[right] != component[i])]
        if within:
            other = other[node[other] > node[i]]
        small, large = np.minimum(size[other], size[i]), np.maximum(size[other], size[i])
        other = other[100 * small >= SIMILAR * large]
        if len(other):
            equal = np.count_nonzero(coordinates[other] == coordinates[i], axis=1)
            other = other[equal >= AGREE * BINS]
        if len(other):
            first = np.argmax(keys[other] == keys[i], axis=1)
            for j in other[first == band]:
                out.append((min(node[i], node[j]), max(node[i], node[j])))
    return out


def _block_pairs(batches):
    """Rows come sorted by block pair; one block pair at a time is held."""
    held, now = [], None
    found: list[tuple[int, int]] = []

    def batch_of(pairs):
        return pa.RecordBatch.from_arrays(
            [pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())],
            names=["a", "b"],
        )

    for batch in batches:
        keys = batch.column("keys").flatten().to_numpy().reshape(-1, BANDS)
        plain = [batch.column(c).to_pylist() for c in ("key", "i", "j", "side", "node", "component", "size", "band", "coordinates")]
        for at, (key, i, j, *row) in enumerate(zip(*plain, strict=True)):
            if (key, i, j) != now:
                if len(held) > 1:
                    found += _met(held)
                held, now = [], (key, i, j)
            held.append((*row, keys[at].copy()))
        if len(found) > 10_000:
            yield batch_of(found)
            found = []
    if len(held) > 1:
        found += _met(held)
    yield batch_of(found)


def _linked_to_block(batches):
    """Rows (big, block, chunk, side, node, shingles) sorted so that a block's own members come first.

    For every other node one link to a member it is similar enough to, if there is one.
    """
    now, owners, sets = None, [], []
    values = holders = sizes = None
    for batch in batches:
        keys = list(zip(*[batch.column(c).to_pylist() for c in ("big", "block", "chunk")], strict=True))
        sides, nodes = batch.column("side").to_pylist(), batch.column("node").to_pylist()
        lists = batch.column("shingles")
        flat, ends = lists.flatten().to_numpy(), np.cumsum([0, *lists.value_lengths().to_pylist()])
        a, b = [], []
        for i, key in enumerate(keys):
            shingles = flat[ends[i] : ends[i + 1]]
            if key != now:
                now, owners, sets, values = key, [], [], None
            if sides[i] == 0:
                owners.append(nodes[i])
                sets.append(shingles.copy())
                continue
            if not sets:
                continue
            if values is None:
                sizes = np.array([len(x) for x in sets])
                values, holders = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
                order = np.argsort(values, kind="stable")
                values, holders = values[order], holders[order]
            low, high = np.searchsorted(values, shingles, "left"), np.searchsorted(values, shingles, "right")
            n = high - low
            at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            common = np.bincount(holders[at], minlength=len(sets))
            similar = np.flatnonzero(100 * common >= SIMILAR * (sizes + len(shingles) - common))
            if len(similar):
                a.append(min(owners[similar[0]], nodes[i]))
                b.append(max(owners[similar[0]], nodes[i]))
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _rest(members: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between different components that share a bucket.

    A node next to a component of ``BIG`` members or more is compared with that whole component,
    exactly and in blocks, once, however many buckets they share. All others meet inside buckets.
    """
    sizes = labels.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") >= BIG)
    big = written(sizes.withColumnRenamed("component", "big"))
    labelled = members.join(labels, "node", "left").select(
        "key", "band", "node", "size", F.coalesce("component", "node").alias("component")
    )
    labelled = labelled.join(big.withColumnRenamed("big", "component"), "component", "left")
    two = (
        labelled.groupBy("key", "band")
        .agg(F.min("component").alias("c1"), F.max("component").alias("c2"))
        .where("c1 != c2")
        .select("key", "band")
    )
    labelled = written(labelled.join(two, ["key", "band"], "left_semi"))

    in_bucket = labelled.where("n is not null").select("key", "band", F.col("component").alias("big"), F.col("n").alias("big_n")).distinct()
    smaller = F.coalesce(F.struct("n", "component") < F.struct("big_n", "big"), F.lit(True))
    next_to = written(
        labelled.join(in_bucket, ["key", "band"])
        .where(F.col("component") != F.col("big"))
        .where(F.col("n").isNull() | smaller)
        .select("node", "big")
        .distinct()
    )
    chunks = next_to.groupBy("big").agg(F.ceil(F.count("*") / CHUNK).alias("chunks")).join(big, "big")
    chunks = chunks.withColumn("blocks", F.ceil(F.col("n") / BLOCK))
    piece = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    owners = (
        labels.withColumnRenamed("component", "big").join(chunks, "big").join(sets.select("node", "shingles"), "node")
        .select("big", piece("blocks").alias("block"), each("chunks").alias("chunk"), F.lit(0).alias("side"), "node", "shingles")
    )
    others = (
        next_to.join(chunks, "big").join(sets.select("node", "shingles"), "node")
        .select("big", each("blocks").alias("block"), piece("chunks").alias("chunk"), F.lit(1).alias("side"), "node", "shingles")
    )
    blocks = owners.union(others).repartition("big", "block", "chunk").sortWithinPartitions("big", "block", "chunk", "side")
    to_big = blocks.mapInArrow(_linked_to_block, "a bigint, b bigint")

    small = labelled.where("n is null")
    mixed = (
        small.groupBy("key", "band")
        .agg(F.min("component").alias("c1"), F.max("component").alias("c2"), F.count("*").alias("members"))
        .where("c1 != c2")
    )
    count = F.ceil(F.col("members") / BLOCK)
    # A block meets itself (side 0) and, as side 1 or 2, every other block of its bucket once.
    spread = (
        small.join(mixed.select("key", "band", "members"), ["key", "band"])
        .withColumn("block", F.pmod(F.xxhash64("node"), count))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), count - 1)))
        .select(
            "key", "band", "node", "component", "size",
            F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
            F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2).alias("side"),
        )
    )
    full = spread.join(sets.select("node", "coordinates", "keys"), "node")
    placed = full.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    pairs = written(placed.mapInArrow(_block_pairs, "a bigint, b bigint").distinct(), batch_rows=5000)
    return written(to_big, batch_rows=200).union(written(_confirmed(pairs, sets), batch_rows=200))


def near_copies(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Two documents are linked if 100 * common >= 75 * all of their distinct five-word shingles; fewer
    than five words make one shingle. Null, empty and blank texts have no shingle and no link. Rows
    with the same doc_id are one document of the linking and give one row each. A null doc_id is
    never linked: component_id null, kept true. Other columns are ignored; an empty table gives none.
    """
    rows = own(docs, "doc_id", "text")
    prints = written(
        rows.mapInArrow(_prints, "doc_id bigint, n_shingles bigint, p1 bigint, p2 bigint, keys array<bigint>"),
        batch_rows=1000,
    )
    # Rows that share a doc_id are one document: the one with the least fingerprint.
    own_print = F.struct("p1", "p2")
    repeated = written(
        prints.where("doc_id is not null and p1 is not null")
        .groupBy("doc_id")
        .agg(F.min(own_print).alias("least"), F.count("*").alias("n"))
        .where("n > 1")
        .select("doc_id", F.col("least.p1").alias("q1"), F.col("least.p2").alias("q2"))
    )
    any_repeated = repeated.limit(1).count() > 0
    if any_repeated:
        prints = prints.join(repeated, "doc_id", "left")
    else:
        prints = prints.withColumns({"q1": F.col("p1"), "q2": F.col("p2")})
    prints = prints.withColumns({"q1": F.coalesce("q1", "p1"), "q2": F.coalesce("q2", "p2")})
    linkable = prints.where("doc_id is not null and p1 is not null and p1 = q1 and p2 = q2")
    classes = written(
        linkable.groupBy("p1", "p2").agg(
            F.min("doc_id").alias("node"), F.first("n_shingles").alias("size"), F.first("keys").alias("keys")
        )
    )
    met = classes.select("node", "size", F.posexplode("keys").alias("band", "key"))
    buckets = met.groupBy("key", "band").agg(F.count("*").alias("n"), F.min("node").alias("pivot")).where("n > 1")
    members = written(met.join(buckets.drop("n"), ["key", "band"]).select("key", "band", "node", "size", "pivot"))

    chosen = BitTable(members.select(place_of(F.col("node"), NODE_BITS).alias("place")), NODE_BITS)
    sets = (
        rows.select("doc_id", "text", place_of(F.col("doc_id"), NODE_BITS).alias("place"))
        .where("doc_id is not null")
        .mapInArrow(_chosen_sets(chosen.sent), _SETS)
    )
    if any_repeated:
        sets = sets.join(classes.select("node", "p1"), ["node", "p1"], "left_semi").dropDuplicates(["node"])
    sets = written(sets, batch_rows=1000)
    stars = members.where("node != pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    links = written(_confirmed(stars, sets), batch_rows=200)
    labels = components(links)
    labels = components(links.union(_rest(members, labels, sets)))

    merged = classes.join(labels, "node", "left").select(
        F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.coalesce("component", "node").alias("component")
    )
    return (
        prints.select("doc_id", "n_shingles", "q1", "q2")
        .join(merged, ["q1", "q2"], "left")
        .select(
            "doc_id",
            "n_shingles",
            F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose document is the smallest of its group, once for each doc_id.

    Rows without a doc_id stay as they are.
    """
    kept = written(near_copies(docs).where("kept and doc_id is not null").select("doc_id"))
    ids = written(kept.distinct())
    chosen = docs.join(small(ids), "doc_id", "left_semi")
    if kept.count() > ids.count():
        chosen = chosen.dropDuplicates(["doc_id"])
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return chosen.select(*columns).union(docs.where("doc_id is null").select(*columns))
