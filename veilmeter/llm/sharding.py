"""Placement of documents on shards through a permutation-filled lookup table (operator 2).

Every shard has a preference order over the slots of a prime-sized table: an offset and a step, both
hashed from its name, visit each slot once. Shards take turns; in its turn a shard claims the first
slot of its order that is still free, until the table is full. Sizes differ by one slot at most, and
when a shard is added or removed most slots keep their owner. A document's slot is a hash of its id,
so placing it is one lookup in the broadcast table, whose size depends on the shards alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Slots for each shard, at least: keeps what a change of shards moves beyond need near 1 percent.
SLOTS_PER_SHARD = 100
#: The table goes to every executor; larger ones are refused (16 bytes a slot).
MOST_SLOTS = 4_000_000
SHARDS = tuple(f"shard-{i:03d}" for i in range(16))


def next_prime(n: int) -> int:
    n = max(n, 2)
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def slots_for(shards: Sequence[str]) -> int:
    return next_prime(SLOTS_PER_SHARD * len(shards) + 1)


def lookup(shards: Sequence[str], slots: int) -> list[int]:
    """Owner of each slot, as the shard's place in ``shards``."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need different names, one at least")
    if not len(shards) <= slots <= MOST_SLOTS or next_prime(slots) != slots:
        raise ValueError(f"slots must be a prime from the number of shards to {MOST_SLOTS}")
    place = [_number(s + "/offset") % slots for s in shards]
    step = [_number(s + "/step") % (slots - 1) + 1 if slots > 1 else 0 for s in shards]
    owner, free = [-1] * slots, slots
    while free:
        for shard in range(min(len(shards), free)):
            while owner[place[shard]] >= 0:
                place[shard] = (place[shard] + step[shard]) % slots
            owner[place[shard]] = shard
            free -= 1
    return owner


def slot_of(key: Column, slots: int) -> Column:
    """Slot of a key; a null key has that of the empty text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"), F.lit(slots))


def shard(docs: DataFrame, shards: Sequence[str] = SHARDS, slots: int | None = None, key: str = "doc_id") -> DataFrame:
    """``docs`` with columns ``slot`` and ``shard``.

    Every row is kept, repeated rows too; equal keys share a shard, null keys that of the empty text.
    Input columns called slot or shard are replaced. There is no shuffle.
    """
    slots = slots or slots_for(shards)
    owners = [(i, shards[o]) for i, o in enumerate(lookup(shards, slots))]
    schema = T.StructType([T.StructField("slot", T.LongType(), False), T.StructField("shard", T.StringType(), False)])
    table = docs.sparkSession.createDataFrame(owners, schema)
    rows = docs.drop("slot", "shard").withColumn("slot", slot_of(F.col(f"`{key}`"), slots))
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("slot", "shard")]
    return rows.join(F.broadcast(table), "slot").select(*kept, "slot", "shard")


def write_shards(docs: DataFrame, path: str, shards: Sequence[str] = SHARDS, files: int = 1) -> None:
    """Write one folder for each shard with about ``files`` files, rows spread evenly over them."""
    placed = shard(docs, shards)
    spread = placed.withColumn("_part", F.pmod(F.xxhash64("slot", F.monotonically_increasing_id()), F.lit(files)))
    spread.repartition(len(shards) * files, "shard", "_part").drop("slot", "_part").write.partitionBy("shard").parquet(path)


def _sql(shards: Sequence[str] = SHARDS) -> str:
    slots = slots_for(shards)
    n = len(shards)
    names = ", ".join(f"({i}, '{s}')" for i, s in enumerate(shards))
    number = lambda what: f"('0x' || substr(md5(name || '/{what}'), 1, 15))::BIGINT"
    return f"""
WITH RECURSIVE s AS (
  SELECT i, name, {number('offset')} % {slots} AS o, {number('step')} % {slots - 1} + 1 AS st
  FROM (VALUES {names}) AS v(i, name)),
orders AS (SELECT list((o + j * st) % {slots} ORDER BY j) AS l, i FROM s, range({slots}) AS r(j) GROUP BY i),
fill AS (
  SELECT 0 AS turn, list_transform(range({slots}), lambda x: -1) AS owner
  UNION ALL
  SELECT turn + 1, list_transform(owner, lambda x, k: CASE WHEN k = slot + 1 THEN turn % {n} ELSE x END)
  FROM (SELECT turn, owner, list_filter(l, lambda x: owner[x + 1] = -1)[1] AS slot
        FROM fill JOIN orders ON orders.i = turn % {n} WHERE turn < {slots})),
t AS (SELECT unnest(range({slots})) AS slot, unnest(owner) AS i FROM fill WHERE turn = {slots}),
d AS (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {slots} AS slot FROM documents)
SELECT doc_id, d.slot, name AS shard FROM d JOIN t USING (slot) JOIN s USING (i)
"""


SHARDING_SQL = _sql()
