"""Cost, budget, latency, alert and evaluation-report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import finops as O
from ..operators import sketches as K
from ..session import durable
from ..sources import tables as T
from .basis import choose, with_
from .metering import facts
from .registry import query

_PROVIDER = choose([m[1] for m in T.MODELS], "event_id")


def budgets(spark, d, per_thousand: int = 1):
    """Budgets of every month with traffic, in thousandths of the tenants' budgets, so that test
    traffic reaches them."""
    limit = (F.col("budget_usd") * per_thousand / 1000).cast("decimal(12,4)")
    tenants = T.tenants(spark).agg(F.collect_list(F.struct("tenant_id", limit.alias("limit_usd"))).alias("all"))
    months = T.events(spark, d).select(F.trunc("ts", "month").alias("month")).distinct()
    every = months.withColumn("key", F.lit(1)).join(F.broadcast(tenants.withColumn("key", F.lit(1))), "key")
    return every.select("month", F.inline("all")).select("tenant_id", "month", "limit_usd")


def calls(spark, d):
    """Provider calls on a time axis 60 times denser than the events."""
    e = T.events(spark, d)
    i = F.col("event_id")
    return e.select(
        "event_id", "user_id", "slug", "tenant_id", "model",
        T.pick([m[1] for m in T.MODELS], i).alias("provider"),
        F.timestamp_micros(F.floor(F.col("us") / 60)).alias("ts"),
        (F.col("event_type") == "error").alias("failed"),
        F.pmod(i, F.lit(2000)).alias("latency_ms"), F.pmod(i * 7, F.lit(701)).alias("ttft_ms"),
    )


_CALLS = f"""(SELECT event_id, user_id, slug, model, {_PROVIDER} AS provider, us // 60 AS us,
    event_type = 'error' AS failed, event_id % 2000 AS latency_ms, (event_id * 7) % 701 AS ttft_ms
    FROM ev)"""
_DAY = "strftime(ts, '%Y-%m-%d')"


@query(
    "f01_cost_by_tenant_day_model",
    with_("facts", then=f"""SELECT tenant_id, {_DAY} AS day, model, count(*) AS requests,
    sum(tokens_in)::BIGINT AS tokens_in, sum(tokens_out)::BIGINT AS tokens_out,
    sum(cost_micros) / 1000000 AS cost_usd FROM facts GROUP BY 1, 2, 3"""),
)
def cost_by_tenant_day_model(spark, d):
    return O.cost_by(facts(spark, d), "tenant_id", F.to_date("ts").alias("day"), "model")


@query(
    "f01_cost_grouping_sets",
    with_("facts", then="""SELECT tenant_id, model, endpoint,
    grouping_id(tenant_id, model, endpoint)::BIGINT AS "grouping", count(*) AS requests,
    sum(cost_micros) / 1000000 AS cost_usd FROM facts
    GROUP BY GROUPING SETS ((tenant_id, model), (endpoint), ())"""),
)
def cost_grouping_sets(spark, d):
    return O.cost_grouping_sets(facts(spark, d), [["tenant_id", "model"], ["endpoint"], []])


@query(
    "f02_monthly_statement",
    with_("facts", "tenants", then="""SELECT strftime(month, '%Y-%m-%d') AS month, coalesce(tenant_id, 'total')
      AS tenant_id, sum(budget)::DOUBLE AS budget_usd, sum(micros) / 1000000 AS spent_usd,
    sum(CASE WHEN budget IS NULL THEN micros ELSE 0 END) / 1000000 AS unbudgeted_usd,
    round(100 * (sum(micros) / 1000000) / sum(budget), 4) AS used_pct,
    sum(n)::BIGINT AS requests, round(100 * sum(hits) / sum(n), 4) AS cache_hit_pct,
    0.0::DOUBLE AS fallback_pct
    FROM (SELECT f.tenant_id, date_trunc('month', ts) AS month, budget_usd AS budget, count(*) AS n,
      sum(cost_micros)::BIGINT AS micros, count(*) FILTER (cache_hit) AS hits FROM facts f
      LEFT JOIN (SELECT * FROM tenants WHERE slug <> 'finance') t ON t.tenant_id = f.tenant_id
      GROUP BY ALL) GROUP BY GROUPING SETS ((month, tenant_id), (month))"""),
)
def monthly_statement(spark, d):
    """One tenant spends without a budget."""
    without = T.tenants(spark).filter("slug = 'finance'").select("tenant_id")
    return O.monthly_statement(facts(spark, d), budgets(spark, d, 1000).join(without, "tenant_id", "left_anti"))


@query(
    "f03_budget_crossings",
    with_("facts", "tenants", then="""SELECT tenant_id, level, strftime(make_timestamp(us),
      '%Y-%m-%d %H:%M:%S.%f') AS crossed_at, total / 1000000 AS spent_usd FROM (
    SELECT tenant_id, level, us, total, row_number() OVER (PARTITION BY tenant_id, level
      ORDER BY us, event_id) AS n FROM (
      SELECT f.tenant_id, f.us, f.event_id::VARCHAR AS event_id, t.budget_usd, sum(cost_micros)
        OVER (PARTITION BY f.tenant_id ORDER BY f.us, f.event_id::VARCHAR)::BIGINT AS total
      FROM facts f JOIN tenants t ON t.tenant_id = f.tenant_id),
      (VALUES ('soft', 800), ('hard', 1000)) l(level, share)
      WHERE total >= budget_usd * share) WHERE n = 1"""),
)
def budget_crossings(spark, d):
    out = O.budget_crossings(facts(spark, d), budgets(spark, d), {"soft": 0.8, "hard": 1.0})
    return out.select("tenant_id", "level", "crossed_at", "spent_usd")


@query(
    "f04_daily_overspend",
    with_("facts", "tenants", then=f"""SELECT f.tenant_id, {_DAY} AS day,
    sum(cost_micros) / 1000000 AS spent_usd FROM facts f JOIN tenants t ON t.tenant_id = f.tenant_id
    GROUP BY f.tenant_id, day, budget_usd HAVING sum(cost_micros) > budget_usd * 500"""),
)
def daily_overspend(spark, d):
    return O.daily_overspend(facts(spark, d), budgets(spark, d)).select("tenant_id", "day", "spent_usd")


@query(
    "f05_error_rate_alerts",
    with_("ev", then=f"""SELECT provider, window_end, calls, errors FROM (
    SELECT provider, window_end, count(*) AS calls, count(*) FILTER (failed) AS errors FROM (
      SELECT *, unnest(range(us // 60000000, us // 60000000 + 5)) AS window_end FROM {_CALLS})
    GROUP BY ALL) WHERE errors * 20 > calls"""),
)
def error_rate_alerts(spark, d):
    return O.error_rate_alerts(calls(spark, d))


@query(
    "f06_slo_streaks",
    with_("ev", then=f"""SELECT min(minute) AS first_minute, max(minute) AS last_minute,
    count(*) AS length, slug FROM (SELECT *, minute - row_number() OVER (PARTITION BY slug
      ORDER BY minute) AS run FROM (SELECT slug, us // 60000000 AS minute FROM {_CALLS}
      GROUP BY ALL HAVING quantile_cont(latency_ms, 0.95) > 500))
    GROUP BY slug, run HAVING count(*) >= 10"""),
)
def slo_streaks(spark, d):
    return O.slo_streaks(calls(spark, d), ["slug"], "latency_ms", 500)


@query(
    "f07_traffic_spikes",
    # On the given time axis; the limit is twice the mean, because test traffic is even.
    with_("ev", then="""SELECT user_id, hour, calls FROM (SELECT *, avg(calls) OVER (
      PARTITION BY user_id ORDER BY hour ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS usual
    FROM (SELECT user_id, us // 3600000000 AS hour, count(*) AS calls FROM ev GROUP BY ALL))
    WHERE calls >= 2 * usual"""),
)
def traffic_spikes(spark, d):
    return O.traffic_spikes(T.events(spark, d), "user_id", times=2).select("user_id", "hour", "calls")


@query(
    "f08_stale_approvals",
    with_("ev", then="""SELECT event_id, ((1705320000000000 - us) // 3600000000)::BIGINT AS age_hours
    FROM ev WHERE event_id % 3 <> 0 AND 1705320000000000 - us > 4 * 3600000000"""),
)
def stale_approvals(spark, d):
    a = T.events(spark, d).select(
        "event_id", F.col("ts").alias("requested_at"),
        F.when(F.pmod("event_id", F.lit(3)) == 0, "approved").alias("decision"),
    )
    now = F.timestamp_micros(F.lit(1_705_320_000_000_000))
    return O.stale_approvals(a, now).select("event_id", "age_hours")


@query(
    "f09_latency_by_model",
    with_("ev", then=f"""SELECT model, round(quantile_cont(latency_ms, 0.5), 4) AS latency_ms_p50,
    round(quantile_cont(latency_ms, 0.95), 4) AS latency_ms_p95,
    round(quantile_cont(ttft_ms, 0.5), 4) AS ttft_ms_p50,
    round(quantile_cont(ttft_ms, 0.95), 4) AS ttft_ms_p95 FROM {_CALLS} GROUP BY model"""),
)
def latency_by_model(spark, d):
    return O.latency_by_model(calls(spark, d))


@query(
    "f10_hit_rates",
    with_("facts", then="""SELECT tenant_id, count(*) AS requests,
    round(avg(cache_hit::INTEGER), 6) AS cache_hit_rate, 0.0::DOUBLE AS fallback_rate
    FROM facts GROUP BY tenant_id"""),
)
def hit_rates(spark, d):
    return O.hit_rates(facts(spark, d), "tenant_id")


# The breaker opens at the first bad second and again at the first bad second after a cool-down.
_BREAKER = f"""RECURSIVE seconds AS (SELECT provider, us // 1000000 AS s, count(*) AS calls,
      count(*) FILTER (failed) AS errors FROM {_CALLS} GROUP BY ALL),
    bad AS (SELECT provider, s FROM (SELECT *, sum(calls) OVER w AS c, sum(errors) OVER w AS e
      FROM seconds WINDOW w AS (PARTITION BY provider ORDER BY s RANGE BETWEEN 29 PRECEDING
      AND CURRENT ROW)) WHERE e * 2 >= c),
    opened AS (SELECT provider, min(s) AS s FROM bad GROUP BY provider
      UNION ALL SELECT o.provider, (SELECT min(b.s) FROM bad b WHERE b.provider = o.provider
        AND b.s >= o.s + 60) FROM opened o WHERE o.s IS NOT NULL)"""


def _with_breaker(then: str) -> str:
    return with_("ev", then="").rstrip().replace("WITH ", f"WITH RECURSIVE ", 1) + ", " + _BREAKER.replace(
        "RECURSIVE ", "", 1) + then


@query(
    "f11_breaker_intervals",
    _with_breaker("""SELECT provider, s::BIGINT AS opened_s, (s + 60)::BIGINT AS closes_s
    FROM opened WHERE s IS NOT NULL"""),
)
def breaker_intervals(spark, d):
    return O.breaker_intervals(calls(spark, d))


@query(
    "f11_calls_during_open_breaker",
    _with_breaker(f"""SELECT c.provider, count(*) AS calls, count(*) FILTER (EXISTS (
      SELECT 1 FROM opened o WHERE o.provider = c.provider AND o.s <= c.us // 1000000
      AND c.us // 1000000 < o.s + 60)) AS skipped FROM {_CALLS} c GROUP BY c.provider"""),
)
def during_open(spark, d):
    c = calls(spark, d)
    return O.during_open(c, O.breaker_intervals(c)).groupBy("provider").agg(
        F.count(F.lit(1)).alias("calls"), F.count_if("breaker_open").alias("skipped")
    )


@query(
    "f12_savings",
    with_("facts", then="""SELECT tenant_id, a / 1000000 AS actual_usd, b / 1000000 AS baseline_usd,
    round(100 * ((b - a) / 1000000) / (b / 1000000), 4) AS saved_pct FROM (SELECT tenant_id,
      sum(cost_micros)::BIGINT AS a, sum(2 * tokens_in + 10 * tokens_out)::BIGINT AS b
      FROM facts GROUP BY tenant_id)"""),
)
def savings(spark, d):
    return O.savings(facts(spark, d), T.catalog(spark), "mock-claude")


@query(
    "f13_reconcile",
    with_("facts", then=f"""SELECT day, model, coalesce(m, 0) / 1000000 AS metered_usd,
    coalesce(r, 0) / 1000000 AS reported_usd, abs(coalesce(m, 0) - coalesce(r, 0)) * 100
      <= coalesce(r, 0) AS within
    FROM (SELECT {_DAY} AS day, model, sum(cost_micros)::BIGINT AS m FROM facts GROUP BY ALL)
    FULL JOIN (SELECT {_DAY} AS day, model, sum(cost_micros)::BIGINT AS r FROM ev
      WHERE model <> 'mock-claude' OR event_id % 2 = 0 GROUP BY ALL) USING (day, model)"""),
)
def reconcile(spark, d):
    day = F.to_date("ts").alias("day")
    metered = facts(spark, d).groupBy(day, "model").agg(F.sum("cost_usd").alias("cost_usd"))
    seen = (F.col("model") != "mock-claude") | (F.pmod("event_id", F.lit(2)) == 0)
    cost = F.sum((F.col("cost_micros").cast("decimal(18,0)") / 1_000_000).cast("decimal(12,6)"))
    reported = T.events(spark, d).filter(seen).groupBy(day, "model").agg(cost.alias("cost_usd"))
    return O.reconcile(metered, reported)


SPANS = ("quota.check", "guard.input", "llm.generate", "rag.retrieve", "guard.output")


def span_overhead(spark, d):
    i = F.col("event_id")
    spans = T.events(spark, d).select(
        F.floor(i / 5).alias("trace_id"), T.pick(SPANS, i).alias("name"),
        F.pmod(i * 13, F.lit(97)).alias("duration_ms"),
    )
    return O.span_overhead(spans, ("llm.generate", "rag.retrieve"))


@query(
    "f14_span_overhead",
    """SELECT count(*) AS traces, round(quantile_cont(o, 0.5), 4) AS p50_ms,
    round(quantile_cont(o, 0.95), 4) AS p95_ms FROM (SELECT event_id // 5 AS t, sum(CASE
      WHEN event_id % 5 IN (2, 3) THEN 0 ELSE (event_id * 13) % 97 END)::BIGINT AS o FROM events
    GROUP BY 1)""",
)
def overhead_percentiles(spark, d):
    counted = span_overhead(spark, d).groupBy("overhead_ms").agg(F.count(F.lit(1)).alias("n"))
    return counted.agg(
        F.sum("n").alias("traces"), F.round(F.percentile("overhead_ms", 0.5, F.col("n")), 4).alias("p50_ms"),
        F.round(F.percentile("overhead_ms", 0.95, F.col("n")), 4).alias("p95_ms"),
    )


# --- latency summaries, citations, gates, samples ---------------------------------------------

@query(
    "e05_latency_summary",
    with_("ev", then=f"""SELECT provider, count(*) AS count,
    round(quantile_cont(latency_ms, 0.5), 2) AS p50_ms, round(quantile_cont(latency_ms, 0.95), 2)
    AS p95_ms, round(sum(latency_ms) / count(*), 2) AS mean_ms FROM {_CALLS} GROUP BY provider"""),
)
def latency_summary(spark, d):
    return E.latency_summary(calls(spark, d), ["provider"], "latency_ms")


@query(
    "e05_sketch_summary",
    with_("ev", then=f"""SELECT provider, count(*) AS count, round(sum(latency_ms) / count(*), 2) AS mean,
    TRUE AS p50_within, TRUE AS p95_within, TRUE AS users_within FROM {_CALLS} GROUP BY provider"""),
)
def sketch_summary(spark, d):
    """The summary from a stored row a minute, and whether it keeps its error bounds against the calls."""
    every = calls(spark, d)
    stored = durable(K.minute_sketches(every, ["provider"], "latency_ms", "user_id"))
    said = K.summary(stored, ["provider"])
    x = F.col("latency_ms")
    true = every.join(F.broadcast(said), "provider").groupBy("provider").agg(
        *[F.avg((x < F.col(q)).cast("double")).alias(f"{q}_below") for q in ("p50", "p95")],
        *[F.avg((x <= F.col(q)).cast("double")).alias(f"{q}_upto") for q in ("p50", "p95")],
        F.countDistinct("user_id").alias("true_users"),
    )

    def within(q: str, share: float):
        return (F.col(f"{q}_below") <= share + K.RANK_ERROR) & (F.col(f"{q}_upto") >= share - K.RANK_ERROR)

    close = F.abs(F.col("users") - F.col("true_users")) <= F.ceil(K.USER_ERROR * F.col("true_users"))
    return said.join(true, "provider").select(
        "provider", "count", "mean", within("p50", 0.5).alias("p50_within"), within("p95", 0.95).alias("p95_within"), close.alias("users_within")
    )


@query(
    "e06_overhead",
    with_("ev", then=f"""WITH s AS (SELECT provider, round(quantile_cont(latency_ms, 0.5), 2) AS a,
    round(quantile_cont(latency_ms, 0.95), 2) AS b, round(sum(latency_ms) / count(*), 2) AS c
    FROM {_CALLS} GROUP BY provider)
    SELECT round(x.a - y.a, 2) AS p50_ms, round(x.b - y.b, 2) AS p95_ms, round(x.c - y.c, 2) AS mean_ms
    FROM s x, s y WHERE x.provider = 'anthropic' AND y.provider = 'ollama'""").replace(
        "\nWITH s AS", ", s AS"),
)
def overhead(spark, d):
    s = E.latency_summary(calls(spark, d), ["provider"], "latency_ms")
    return E.overhead(s, "provider", "ollama", "anthropic")


@query(
    "e08_citation_check",
    """SELECT conv_id, turn, conv_id % 4 + 1 <= turn % 6 AND 2 <= turn % 6 AS citations_ok
    FROM conversations""",
)
def citations(spark, d):
    answer = F.concat(
        F.col("text"), F.lit(" theo ["), (F.pmod("conv_id", F.lit(4)) + 1).cast("string"), F.lit("] và [2][2]")
    )
    a = T.read(spark, d, "conversations").select(
        "conv_id", "turn", answer.alias("answer"), F.pmod("turn", F.lit(6)).cast("int").alias("n_sources")
    )
    return E.check_citations(a).select("conv_id", "turn", "citations_ok")


THRESHOLDS = (("correctness", 0.85, None), ("pii_leak", None, 0.0), ("length_score", None, None))


def scores(spark, d):
    """Scores of labelled documents as samples of three metrics."""
    labelled = T.read(spark, d, "labels")
    pairs = F.array(
        F.struct(F.lit("correctness").alias("metric"), F.col("quality").cast("double").alias("score")),
        F.struct(F.lit("pii_leak").alias("metric"), F.col("toxic").cast("double").alias("score")),
        F.struct(F.lit("length_score").alias("metric"),
                 F.pmod("doc_id", F.lit(2)).cast("double").alias("score")),
    )
    return labelled.select(F.col("doc_id").alias("sample_id"), F.inline(pairs))


def _gate_inputs(spark, d):
    limits = spark.createDataFrame(list(THRESHOLDS), "metric string, at_least double, at_most double")
    base = scores(spark, d).groupBy("metric").agg(
        F.round(F.avg(F.when(F.pmod("sample_id", F.lit(2)) == 0, F.col("score"))), 6).alias("baseline")
    )
    return limits, base


@query(
    "e09_eval_gate",
    """WITH s AS (SELECT doc_id, unnest([{'m': 'correctness', 's': quality::DOUBLE},
      {'m': 'pii_leak', 's': toxic::DOUBLE}, {'m': 'length_score', 's': (doc_id % 2)::DOUBLE}]) AS x
      FROM labels),
    a AS (SELECT x.m AS metric, round(avg(x.s), 6) AS score,
      round(avg(x.s) FILTER (doc_id % 2 = 0), 6) AS baseline FROM s GROUP BY 1)
    SELECT metric, score, baseline, round(score - baseline, 6) AS change, CASE
      WHEN metric = 'length_score' THEN 'report'
      WHEN (metric = 'correctness' AND score < 0.85) OR (metric = 'pii_leak' AND score > 0)
      THEN 'block' ELSE 'merge' END AS verdict FROM a""",
)
def eval_gate(spark, d):
    limits, base = _gate_inputs(spark, d)
    return E.gate(scores(spark, d), limits, base)


@query(
    "e09_failing_samples",
    """SELECT doc_id AS sample_id, 'correctness' AS metric, quality::DOUBLE AS score FROM labels
    WHERE quality < 0.85 UNION ALL SELECT doc_id, 'pii_leak', toxic::DOUBLE FROM labels
    WHERE toxic > 0""",
)
def failing_samples(spark, d):
    limits, _ = _gate_inputs(spark, d)
    return E.failing_samples(scores(spark, d), limits)


_BUCKET = "('0x' || sha256(event_id::VARCHAR)[1:8])::BIGINT % 100 < 5"


@query("e10_traffic_sample", f"SELECT event_id, event_type FROM events WHERE {_BUCKET}")
def traffic_sample(spark, d):
    return E.traffic_sample(T.read(spark, d, "events"), "event_id").select("event_id", "event_type")


@query(
    "e10_weekly_trend",
    f"""SELECT strftime(date_trunc('week', ts)::TIMESTAMP, '%Y-%m-%d %H:%M:%S.%f') AS week,
    count(*) AS samples, round(avg(event_id % 5), 6) AS mean_score FROM events WHERE {_BUCKET}
    GROUP BY 1""",
)
def weekly_trend(spark, d):
    s = E.traffic_sample(T.read(spark, d, "events"), "event_id")
    return E.weekly_trend(s.withColumn("score", F.pmod("event_id", F.lit(5))))


