"""Skewed groups give the same ranks, sums and lookups as plain windows."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from veilmeter.operators import quota
from veilmeter.frames import skew


def skewed(spark, n=20_000):
    """Half of all rows in one group, with many equal times."""
    i = F.col("id")
    return spark.range(n).select(
        F.when(i % 2 == 0, "big").when(i % 11 == 0, F.lit(None)).otherwise(F.concat(F.lit("k"), (i % 40).cast("string"))).alias("k"),
        (F.xxhash64("id") % 500).alias("t"), i.alias("id"), (i % 7).alias("v"),
    ).repartition(8)


def test_running_matches_a_plain_window(spark):
    df = skewed(spark)
    w = Window.partitionBy("k").orderBy("t", "id")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    want = df.select("id", F.row_number().over(w).alias("n"), F.sum("v").over(upto).alias("s"))
    for width in (None, 1, 50, 10**6):
        cut = None if width is None else F.floor(F.col("t") / width)
        got = skew.running(df, ["k"], ["t", "id"], sums={"s": F.col("v")}, rank="n", slice=cut)
        got = got.select("id", F.col("n").cast("int").alias("n"), "s")
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_a_hot_group_is_really_cut(spark):
    df = skewed(spark)
    got = skew.running(df, ["k"], ["t", "id"], rank="n", slice=F.floor(F.col("t") / 20))
    sizes = got.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    plain = df.repartition(8, "k").groupBy(F.spark_partition_id()).count()
    assert sizes < plain.agg(F.max("count")).first()[0]


def test_replay_does_not_depend_on_the_cut(spark):
    df = skewed(spark).select(
        F.col("k").alias("tenant"), (F.col("t") % 3).alias("bucket"), F.col("t").alias("ts"),
        F.col("id").alias("request_id"), (F.col("v") + 1).alias("tokens"),
        F.lit(60).cast("bigint").alias("rpm"), F.lit(200).cast("bigint").alias("tpm"),
    )
    a = quota.replay(df)
    b = quota.replay(df, slice=F.floor(F.col("ts") / 10))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    per = a.groupBy("tenant", "bucket").agg(
        F.sum(F.col("admitted").cast("int")).alias("n"),
        F.max(F.when(F.col("admitted"), F.col("tpm_count"))).alias("t"),
    )
    assert per.filter("n > 60 OR t > 200").count() == 0


def test_latest_within_matches_brute_force(spark):
    known = spark.range(400).select(
        F.lit("a").alias("k"), F.timestamp_seconds(F.xxhash64("id") % 4000 + 10_000).alias("put"),
        F.col("id").alias("value"),
    ).dropDuplicates(["put"])
    asked = spark.range(400).select(
        F.col("id"), F.lit("a").alias("k"),
        F.timestamp_seconds(F.xxhash64(F.col("id") + 999) % 5000 + 10_000).alias("got"),
    )
    rows = skew.latest_within(asked, known, ["k"], "got", "put", 30, "value").collect()
    puts = sorted((r.put, r.value) for r in known.collect())
    for r in rows:
        past = [(p, v) for p, v in puts if p <= r.got and (r.got - p).total_seconds() <= 30]
        assert r.value == (past[-1][1] if past else None)
