"""Chat logs to training text: collapse cumulative snapshots, then render (operator 8).

A service that logs the whole history with every call stores each conversation many times, as
prefixes of the longest. Every turn gets the hash of the conversation up to it; a conversation whose
last hash occurs inside a longer one is a snapshot of it and goes, and of equal conversations the
smallest conv_id stays.

The rolling hash is the exclusive or of 64-bit hashes of (place, turn), twice with different seeds:
it adds up over blocks of ``BLOCK`` turns by place, so a conversation that holds a large part of all
rows is hashed block by block. Places come from counts of ever smaller slices along the order (turn
numbers, number and role, the first digits of the text's digest), so rows meet only inside the
smallest, whether or not turns are numbered. Rendered text is cut into parts of ``BLOCK`` turn
numbers, or of as many turns where a number is used too often for that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import own, small, written

BLOCK = 512
UNKNOWN = "unknown"


def _block() -> Column:
    """Turns without a number come last."""
    return F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(2**62))


def _turns(conversations: DataFrame) -> DataFrame:
    """Plain turns: a null role is 'unknown', a null text empty."""
    rows = own(conversations, "conv_id", "turn", "role", "text")
    return rows.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit(UNKNOWN)).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        _block().alias("part"),
    )


def _distinct(conversations: DataFrame) -> DataFrame:
    rows = _turns(conversations).select("conv_id", "turn", "part", "role", F.md5("text").alias("digest")).distinct()
    return rows.withColumn("number", F.coalesce("turn", F.lit(2**62)))


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Join on ``keys``; conv_id may be null, role and the others may not."""
    same = F.lit(True)
    for key in keys:
        same = same & F.col(f"l.{key}").eqNullSafe(F.col(f"r.{key}"))
    added = [F.col(f"r.{c}") for c in right.columns if c not in keys]
    return left.alias("l").join(right.alias("r"), same).select("l.*", *added)


def _placed(rows: DataFrame) -> DataFrame:
    """Distinct rows with their place in the conversation, from 1 on."""
    slices = [["conv_id"], ["part"], ["number", "role"], ["first"]]
    rows = rows.withColumn("first", F.substring("digest", 1, 3))
    keys = [sum(slices[: k + 1], []) for k in range(len(slices))]
    totals = rows.withColumn("n", F.lit(1))
    tables = []
    for k in range(len(slices) - 1, 0, -1):
        totals = totals.groupBy(*keys[k]).agg(F.sum("n").alias("n"))
        before = Window.partitionBy(*keys[k - 1]).orderBy(*slices[k]).rowsBetween(Window.unboundedPreceding, -1)
        tables.append(totals.select(*keys[k], F.coalesce(F.sum("n").over(before), F.lit(0)).alias(f"skip{k}")))
    skips = tables[0]
    for k, table in zip(range(len(slices) - 2, 0, -1), tables[1:], strict=True):
        skips = _same(skips, table, keys[k])
    skip = sum((F.col(f"skip{k}") for k in range(2, len(slices))), F.col("skip1"))
    inside = Window.partitionBy(*keys[-1]).orderBy("digest")
    rows = rows.withColumn("in_slice", F.row_number().over(inside).cast("bigint"))
    rows = _same(rows, skips.select(*keys[-1], skip.alias("skip")), keys[-1])
    return rows.withColumn("place", F.col("skip") + F.col("in_slice")).drop("skip", "in_slice", "first")


def prefixes(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, one, two): a hash of every turn with all turns before it."""
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = _placed(_distinct(conversations)).select(
        "conv_id", F.floor((F.col("place") - 1) / BLOCK).alias("part"), "place", "role", F.col("digest").alias("text")
    )
    hashed = placed.select(
        "conv_id", "part", "place",
        F.xxhash64(F.lit(1), "place", "role", "text").alias("one"),
        F.xxhash64(F.lit(2), "place", "role", "text").alias("two"),
    )
    upto = Window.partitionBy("conv_id", "part").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    run = hashed.select("conv_id", "part", "place", *[F.bit_xor(c).over(upto).alias(c) for c in ("one", "two")])
    totals = hashed.groupBy("conv_id", "part").agg(F.bit_xor("one").alias("t1"), F.bit_xor("two").alias("t2"))
    totals = totals.select(
        "conv_id", "part", *[F.coalesce(F.bit_xor(c).over(before), F.lit(0)).alias(c) for c in ("t1", "t2")]
    )
    return _same(run, totals, ["conv_id", "part"]).select(
        "conv_id", "place", F.col("one").bitwiseXOR(F.col("t1")).alias("one"), F.col("two").bitwiseXOR(F.col("t2")).alias("two")
    )


def maximal(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns) of the conversations that are no prefix of another."""
    every = written(prefixes(conversations))
    ends = every.groupBy("conv_id").agg(F.max(F.struct("place", "one", "two")).alias("end"))
    ends = ends.select("conv_id", "end.*")
    inner = (
        every.alias("e")
        .join(ends.alias("n"), F.col("e.conv_id").eqNullSafe(F.col("n.conv_id")) & (F.col("e.place") < F.col("n.place")))
        .select("e.place", "e.one", "e.two")
        .distinct()
    )
    whole = ends.groupBy("place", "one", "two").agg(F.min("conv_id").alias("conv_id"))
    kept = whole.join(inner, ["place", "one", "two"], "left_anti")
    return kept.select("conv_id", F.col("place").alias("n_turns"))


def rendered(role: Column, text: Column) -> Column:
    """One turn with its marks; marks inside a text lose their bars."""
    safe = F.regexp_replace(text, r"<\|(im_start|im_end)\|>", "<$1>")
    return F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), safe, F.lit("<|im_end|>\n"))


def chats(conversations: DataFrame) -> DataFrame:
    """(conv_id, part, n_turns, chat): the rendered text of every maximal conversation.

    Turns go by number, those without one last, ties by role and text; a row repeated exactly counts
    once. Rows without conv_id make one conversation. A conversation of up to ``BLOCK`` turn numbers
    is one row (part 0 if it starts at 0); a longer one has a row for each ``BLOCK`` numbers, to be
    joined by part. If more than ``BLOCK`` turns share such numbers, or have none, the conversation
    is cut by place instead, ``BLOCK`` turns to a part. ``n_turns`` counts the row's turns. Other
    columns are ignored.
    """
    kept = written(maximal(conversations).select(F.col("conv_id").alias("kept_id")))
    turns = _turns(conversations).withColumn("digest", F.md5("text"))
    turns = turns.join(small(kept), turns["conv_id"].eqNullSafe(F.col("kept_id")), "left_semi")
    turns = turns.withColumn("number", F.coalesce("turn", F.lit(2**62)))
    crowded = _distinct(conversations).groupBy("conv_id", "part").count().where(F.col("count") > BLOCK)
    crowded = written(crowded.select(F.col("conv_id").alias("crowded_id")).distinct())
    of_these = turns["conv_id"].eqNullSafe(F.col("crowded_id"))
    common = turns.join(small(crowded), of_these, "left_anti")
    rows = ["conv_id", "part", "number", "role", "digest", "text"]
    cut = turns.join(small(crowded), of_these, "left_semi").dropDuplicates(["conv_id", "turn", "role", "digest"])
    cut = _placed(cut.select(*rows)).withColumn("part", F.floor((F.col("place") - 1) / BLOCK))
    turns = common.select(*rows).unionByName(cut.select(*rows))
    piece = F.struct("number", "role", "digest", "text")
    parts = turns.groupBy("conv_id", "part").agg(F.array_sort(F.collect_set(piece)).alias("turns"))
    return parts.select(
        "conv_id",
        "part",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: rendered(t["role"], t["text"])), "").alias("chat"),
    )


#: The same where no part holds more than BLOCK turns, as in the given tables.
CHATS_SQL = r"""
WITH t AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
         coalesce(turn, 4611686018427387904) AS number,
         CASE WHEN turn IS NULL THEN 4611686018427387904 ELSE floor(turn / 512)::BIGINT END AS part
  FROM conversations),
c AS (SELECT conv_id, list(md5(role || chr(1) || text) ORDER BY number, role, md5(text)) AS l FROM t GROUP BY conv_id),
p AS (SELECT DISTINCT l[1:k] AS l FROM (SELECT l, unnest(range(1, len(l))) AS k FROM c)),
k AS (SELECT min(conv_id) AS conv_id, l FROM c GROUP BY l),
m AS (SELECT conv_id FROM k ANTI JOIN p ON k.l = p.l)
SELECT t.conv_id, part, count(*) AS n_turns,
       string_agg('<|im_start|>' || role || chr(10)
         || regexp_replace(text, '<\|(im_start|im_end)\|>', '<\1>', 'g') || '<|im_end|>' || chr(10),
         '' ORDER BY number, role, md5(text)) AS chat
FROM t JOIN m ON t.conv_id IS NOT DISTINCT FROM m.conv_id GROUP BY t.conv_id, part
"""
