"""Exact ranks, running sums and as-of lookups that stay spread out when one group is huge.

A plain window sends a whole group to one task. Where a group may be large, the caller names a slice:
an expression that never falls along the order, such as the minute of a time. Totals per group and
slice are map-side combined, a window over a group's slices turns them into offsets, and the rows
themselves only meet within their slice. The plan is the same for every size; the input is read
twice.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: dict[str, Column] | None = None,
    rank: str | None = None,
    slice: Column | None = None,
) -> DataFrame:
    """Add the position (``rank``) and running ``sums`` of each row within its group.

    ``order`` must be a total order within a group, and ``slice`` must not fall along it. Without a
    slice a group is one window: only for groups that are small by nature. NULL keys are a group.
    """
    sums = dict(sums or {})
    columns = [F.col(c) for c in df.columns]
    by = [*keys, "_slice"]
    df = df.withColumn("_slice", F.lit(0) if slice is None else slice)
    here = Window.partitionBy(*by).orderBy(*order)
    upto = here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = {name: F.sum(value).over(upto) for name, value in sums.items()}
    if rank:
        found[rank] = F.row_number().over(here).cast("bigint")
    local = df.select("*", *[c.alias(f"_at_{name}") for name, c in found.items()])
    if slice is None:
        return local.select(*columns, *[F.col(f"_at_{name}").alias(name) for name in found])
    totals = df.groupBy(*by).agg(
        *[F.sum(value).alias(f"_all_{name}") for name, value in sums.items()],
        *([F.count(F.lit(1)).alias(f"_all_{rank}")] if rank else []),
    )
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)],
        *[F.sum(f"_all_{name}").over(before).alias(f"_off_{name}") for name in found],
    )
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)])
    # A sum of nothing but NULLs stays NULL; an offset alone is a sum.
    whole = {
        name: F.when(F.col(f"_at_{name}").isNull(), F.col(f"_off_{name}"))
        .otherwise(F.col(f"_at_{name}") + F.coalesce(F.col(f"_off_{name}"), F.lit(0)))
        for name in found
    }
    return local.join(offsets, same).select(*columns, *[c.alias(name) for name, c in whole.items()])


def before(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], slice: Column) -> DataFrame:
    """Add ``before``: the ``values`` of the row before each row of its group, as a struct; NULL for the first.

    Numbers of ``order`` may have gaps of any length. ``slice`` must not fall along it.
    """
    by = [*keys, "_slice"]
    sliced = df.withColumn("_slice", slice)
    row = F.struct(*values)
    local = sliced.withColumn("_local", F.lag(row).over(Window.partitionBy(*by).orderBy(*order)))
    ends = sliced.groupBy(*by).agg(F.max_by(row, F.struct(*order)).alias("_end"))
    passed_on = F.lag("_end").over(Window.partitionBy(*keys).orderBy("_slice"))
    ends = ends.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], passed_on.alias("_passed_on"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)])
    return local.join(ends, same).select(*[F.col(c) for c in df.columns], F.coalesce("_local", "_passed_on").alias("before"))


def latest_within(
    asked: DataFrame,
    known: DataFrame,
    keys: Sequence[str],
    at: str,
    known_at: str,
    seconds: int,
    value: str,
) -> DataFrame:
    """For each ``asked`` row the ``value`` last ``known`` at most ``seconds`` before it, or NULL.

    Time is cut into slices of that length. A known row can matter in its own slice and the next,
    so it is placed in both and one window per key and slice answers every question.
    """
    columns = asked.columns
    micros = seconds * 1_000_000

    def moment(c: str) -> Column:
        return F.unix_micros(F.col(c))

    left = asked.select(
        *keys,
        moment(at).alias("_us"),
        F.floor(moment(at) / micros).cast("bigint").alias("_slice"),
        F.lit(1).alias("_asks"),
        F.struct(*columns).alias("_row"),
        F.lit(None).cast(f"struct<us:bigint,value:{_type(known, value)}>").alias("_hit"),
    )
    own = F.floor(moment(known_at) / micros).cast("bigint")
    right = known.select(
        *keys,
        moment(known_at).alias("_us"),
        F.explode(F.array(own, own + 1)).alias("_slice"),
        F.lit(0).alias("_asks"),
        F.lit(None).cast(left.schema["_row"].dataType).alias("_row"),
        F.struct(moment(known_at).alias("us"), F.col(value).alias("value")).alias("_hit"),
    )
    w = (
        Window.partitionBy(*keys, "_slice")
        .orderBy("_us", "_asks")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    seen = left.unionByName(right).withColumn("_last", F.last("_hit", ignorenulls=True).over(w))
    fresh = F.when(F.col("_us") - F.col("_last.us") <= micros, F.col("_last.value"))
    return seen.filter("_asks = 1").select("_row.*", fresh.alias(value))


def _type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()
