"""Detection quality, latency summaries, retrieval quality and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pii
from ..functions.text import computed_once

# Names used by the labelled corpus.
CORPUS_NAMES = ("Nguyễn Văn An", "Trần Thị Bình", "Lê Minh Châu", "Phạm Gia Hân")


def labelled_corpus(indexes: DataFrame, index: str = "i") -> DataFrame:
    """Known-answer texts built from each index: one of every kind plus a negative."""
    i = F.col(index).cast("bigint")
    name = F.get(F.array(*[F.lit(n) for n in CORPUS_NAMES]), (i % 4).cast("int"))

    def case(no: int, kind: str | None, before: str, value: Column, after: str = ""):
        return F.struct(
            F.lit(no).alias("case_no"),
            F.concat(F.lit(before), F.coalesce(value, F.lit("")), F.lit(after)).alias("text"),
            F.lit(kind).cast("string").alias("kind"),
            value.alias("value"),
        )

    nothing = F.lit(None).cast("string")
    product = F.concat((1000 + i).cast("string"), F.lit(", giá "), (i + 1).cast("string"))
    negative = F.struct(
        F.lit(6).alias("case_no"),
        F.concat(F.lit("Mã sản phẩm SP-"), product, F.lit("000 đồng")).alias("text"),
        nothing.alias("kind"),
        nothing.alias("value"),
    )
    cases = F.array(
        case(0, "PHONE", "Liên hệ ", F.concat(F.lit("09"), F.lpad(i.cast("string"), 8, "0"))),
        case(1, "CCCD", "CCCD ", F.concat(F.lit("001"), F.lpad(i.cast("string"), 9, "0"))),
        case(2, "BANK", "STK: ", (10_000_000 + i).cast("string")),
        case(3, "EMAIL", "Email ",
             F.concat(F.lit("khach"), i.cast("string"), F.lit("@example.com"))),
        case(4, "ORDER", "Đơn ", F.concat(F.lit("#A"), (1000 + i).cast("string")),
             " cần kiểm tra"),
        case(5, "NAME", "Khách hàng: ", name),
        negative,
    )
    return indexes.select(index, F.explode(cases).alias("c")).select(index, "c.*")


def case_outcomes(cases: DataFrame) -> DataFrame:
    """Add the distinct (kind, value) pairs detected in each case."""
    pairs = F.array_distinct(
        F.transform(
            pii.entities(F.col("text")),
            lambda e: F.struct(e["kind"].alias("kind"), e["value"].alias("value")),
        )
    )
    return cases.withColumn("detected", pairs)


def confusion(outcomes: DataFrame) -> DataFrame:
    """Per kind: samples, true/false positives, false negatives, precision and recall.

    Negatives add false positives only. Every row is reduced inside its own case first.
    """
    want = F.struct(F.col("kind").alias("kind"), F.col("value").alias("value"))
    hit = F.coalesce(F.array_contains("detected", want), F.lit(False))
    wrong = F.filter("detected", lambda p: F.col("kind").isNull() | (p != want))
    own = F.when(
        F.col("kind").isNotNull(),
        F.array(F.struct(
            F.col("kind").alias("kind"), F.lit(1).alias("n"), hit.cast("int").alias("tp"),
            F.lit(0).alias("fp"), (~hit).cast("int").alias("fn"),
        )),
    ).otherwise(F.array().cast("array<struct<kind:string,n:int,tp:int,fp:int,fn:int>>"))
    others = F.transform(
        wrong,
        lambda p: F.struct(p["kind"].alias("kind"), F.lit(0).alias("n"), F.lit(0).alias("tp"),
                           F.lit(1).alias("fp"), F.lit(0).alias("fn")),
    )

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b == 0, F.lit(1.0)).otherwise(F.bround(a / b, 4))

    s = outcomes.select(F.inline(F.concat(own, others))).groupBy("kind").agg(
        F.sum("n").alias("samples"), F.sum("tp").alias("true_positive"),
        F.sum("fp").alias("false_positive"), F.sum("fn").alias("false_negative"),
    )
    tp, fp, fn = F.col("true_positive"), F.col("false_positive"), F.col("false_negative")
    return s.select("*", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"))


def leakage(cases: DataFrame) -> DataFrame:
    """Add ``redacted`` and ``leaks``: the case's expected value survives its redaction."""
    both = computed_once(cases, {"_found": pii.entities(F.col("text"))})
    redacted = F.get(
        pii.redact_texts(F.array("text"), F.array("_found"), pii.numbering(F.col("_found"))),
        F.lit(0),
    )
    out = computed_once(both, {"redacted": redacted}).drop("_found")
    return out.withColumn("leaks", F.coalesce(F.contains("redacted", F.col("value")), F.lit(False)))


def latency_summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Count, p50, p95 (linear interpolation) and mean per group, rounded to two digits.

    Equal values collapse before the percentile, so its state is the number of distinct values.
    """
    x = F.col(value)
    counted = df.groupBy(*by, x.alias("_x")).agg(F.count(F.lit(1)).alias("_n"))
    return counted.groupBy(*by).agg(
        F.sum("_n").alias("count"),
        F.round(F.percentile("_x", 0.5, F.col("_n")), 2).alias("p50_ms"),
        F.round(F.percentile("_x", 0.95, F.col("_n")), 2).alias("p95_ms"),
        F.round(F.sum(F.col("_x") * F.col("_n")) / F.sum("_n"), 2).alias("mean_ms"),
    )


def overhead(summary: DataFrame, path: str, direct: str, proxied: str) -> DataFrame:
    """Difference of the latency summaries of two groups."""
    def of(name: str, measure: str) -> Column:
        return F.max(F.when(F.col(path) == name, F.col(measure)))

    return summary.agg(*[
        F.round(of(proxied, m) - of(direct, m), 2).alias(m) for m in ("p50_ms", "p95_ms", "mean_ms")
    ])


def retrieval_quality(ranked: DataFrame, golden: DataFrame, k: int = 6) -> DataFrame:
    """recall@k and mean reciprocal rank against golden (query_id, doc_id) pairs.

    ``ranked`` holds (query_id, doc_id, rank).
    """
    joined = golden.join(ranked, ["query_id", "doc_id"], "left")
    per_query = joined.groupBy("query_id").agg(
        (F.count_if(F.col("rank") <= k) / F.count(F.lit(1))).alias("recall"),
        F.coalesce(F.max(1 / F.col("rank")), F.lit(0.0)).alias("rr"),
    )
    return per_query.agg(
        F.count(F.lit(1)).alias("queries"),
        F.round(F.avg("recall"), 6).alias("recall_at_k"),
        F.round(F.avg("rr"), 6).alias("mrr"),
    )


def check_citations(answers: DataFrame, answer: str = "answer", sources: str = "n_sources"):
    """Add ``cited`` and ``citations_ok``: every ``[n]`` names one of the numbered sources."""
    cited = F.array_distinct(
        F.transform(
            F.regexp_extract_all(F.col(answer), F.lit(r"\[(\d+)\]"), 1),
            lambda n: n.try_cast("int"),
        )
    )
    have = F.when(F.col(sources) > 0, F.sequence(F.lit(1), F.col(sources))).otherwise(
        F.array().cast("array<int>")
    )
    return answers.withColumn("cited", cited).withColumn(
        "citations_ok", F.size(F.array_except("cited", have)) == 0
    )


def gate(scores: DataFrame, thresholds: DataFrame, baseline: DataFrame) -> DataFrame:
    """Compare average metric scores with thresholds and the main branch.

    ``thresholds`` holds (metric, at_least, at_most), either may be NULL; a metric with neither is
    only reported.
    """
    mean = scores.groupBy("metric").agg(F.round(F.avg("score"), 6).alias("score"))
    joined = mean.join(thresholds, "metric", "left").join(baseline, "metric", "left")
    fails = F.coalesce(F.col("score") < F.col("at_least"), F.lit(False)) | F.coalesce(
        F.col("score") > F.col("at_most"), F.lit(False)
    )
    report_only = F.col("at_least").isNull() & F.col("at_most").isNull()
    return joined.select(
        "metric", "score", "baseline",
        F.round(F.col("score") - F.col("baseline"), 6).alias("change"),
        F.when(report_only, "report").when(fails, "block").otherwise("merge").alias("verdict"),
    )


def failing_samples(scores: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Samples below (or above) their metric's limit."""
    bad = (F.col("score") < F.col("at_least")) | F.coalesce(
        F.col("score") > F.col("at_most"), F.lit(False)
    )
    return scores.join(thresholds, "metric").filter(bad).select("sample_id", "metric", "score")


def traffic_sample(df: DataFrame, id_column: str, percent: int = 5) -> DataFrame:
    """Deterministic sample of real traffic: the same id is always in or out."""
    bucket = F.conv(F.substring(F.sha2(F.col(id_column).cast("string"), 256), 1, 8), 16, 10)
    return df.filter(F.pmod(bucket.cast("bigint"), F.lit(100)) < percent)


def weekly_trend(scored: DataFrame, ts: str = "ts", score: str = "score") -> DataFrame:
    return scored.groupBy(F.date_trunc("week", F.col(ts)).alias("week")).agg(
        F.count(F.lit(1)).alias("samples"), F.round(F.avg(score), 6).alias("mean_score")
    )
