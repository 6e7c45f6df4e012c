"""Cost, budget, latency and alert reporting over usage facts.

Reports first collapse facts to small time buckets with map-side combine and only then look along
time, so one dominant tenant or provider never ends up in a single sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..frames import skew


def cost_by(facts: DataFrame, *dims: Column | str) -> DataFrame:
    """Requests, tokens and cost per chosen dimensions."""
    return facts.groupBy(*dims).agg(
        F.count(F.lit(1)).alias("requests"),
        F.sum("tokens_in").alias("tokens_in"),
        F.sum("tokens_out").alias("tokens_out"),
        F.sum("cost_usd").alias("cost_usd"),
    )


def cost_grouping_sets(facts: DataFrame, sets: list[list[str]]) -> DataFrame:
    """Cost for several groupings at once; facts collapse to the finest grouping first."""
    dims = list(dict.fromkeys(c for s in sets for c in s))
    finest = facts.groupBy(*dims).agg(
        F.count(F.lit(1)).alias("requests"), F.sum("cost_usd").alias("cost_usd")
    )
    return finest.groupingSets([[F.col(c) for c in s] for s in sets], *dims).agg(
        F.grouping_id(*dims).alias("grouping"),
        F.sum("requests").alias("requests"),
        F.sum("cost_usd").alias("cost_usd"),
    )


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole != 0, F.round(100 * part.cast("double") / whole.cast("double"), 4))


def monthly_statement(facts: DataFrame, budgets: DataFrame) -> DataFrame:
    """Budget, spending and rates of each tenant and month, with a total row per month.

    Spending without a budget has a row too, with null budget, and counts as ``unbudgeted_usd``.
    """
    month = F.trunc(F.col("ts"), "month")
    spent = facts.groupBy("tenant_id", month.alias("month")).agg(
        F.count(F.lit(1)).alias("requests"), F.sum("cost_usd").alias("spent_usd"),
        F.count_if("cache_hit").alias("hits"), F.count_if("fallback").alias("fallbacks"),
    )
    joined = budgets.join(spent, ["tenant_id", "month"], "full").withColumn(
        "unbudgeted_usd", F.when(F.col("limit_usd").isNull(), F.col("spent_usd"))
    )
    rolled = joined.groupingSets(
        [[F.col("month"), F.col("tenant_id")], [F.col("month")]], "month", "tenant_id"
    ).agg(
        F.sum("limit_usd").alias("budget_usd"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c)
          for c in ("spent_usd", "unbudgeted_usd", "requests", "hits", "fallbacks")],
    )
    return rolled.select(
        "month", F.coalesce("tenant_id", F.lit("total")).alias("tenant_id"), "budget_usd",
        "spent_usd", "unbudgeted_usd", percent(F.col("spent_usd"), F.col("budget_usd")).alias("used_pct"),
        "requests", percent(F.col("hits"), F.col("requests")).alias("cache_hit_pct"),
        percent(F.col("fallbacks"), F.col("requests")).alias("fallback_pct"),
    )


def budget_crossings(
    facts: DataFrame, budgets: DataFrame, levels: dict[str, float], order: str = "stream_id"
) -> DataFrame:
    """When cumulative spending of a tenant and month first reaches each share of its budget.

    Spending per second finds the second of the crossing; only that second's facts are read again
    to find the exact event. Never reached levels give no row.
    """
    keys = ["tenant_id", "month"]
    timed = facts.select(
        "tenant_id", F.trunc("ts", "month").alias("month"), F.unix_micros("ts").alias("us"),
        F.floor(F.unix_micros("ts") / 1_000_000).alias("second"), order, "cost_usd",
    )
    seconds = timed.groupBy(*keys, "second").agg(F.sum("cost_usd").alias("spent"))
    # A month has at most 2.7 million seconds, which bounds this window.
    upto = Window.partitionBy(*keys).orderBy("second").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    burn = seconds.withColumn("total", F.sum("spent").over(upto))
    marks = F.explode(F.array(*[
        F.struct(F.lit(name).alias("level"),
                 (F.col("limit_usd") * F.lit(str(share)).cast("decimal(6,4)")).alias("at_usd"))
        for name, share in levels.items()
    ])).alias("m")
    limits = budgets.select(*keys, marks).select(*keys, "m.*")
    crossed = (
        burn.join(limits, keys)
        .filter((F.col("total") >= F.col("at_usd")) & (F.col("total") - F.col("spent") < F.col("at_usd")))
        .select(*keys, "level", "at_usd", "second", (F.col("total") - F.col("spent")).alias("before"))
    )
    inside = timed.join(crossed, [*keys, "second"])
    exact = skew.running(
        inside, [*keys, "level"], ["us", order], sums={"_within": F.col("cost_usd")},
        slice=F.floor(F.col("us") / 1000),
    ).withColumn("total", F.col("before") + F.col("_within"))
    return (
        exact.filter("total >= at_usd")
        .groupBy(*keys, "level", "at_usd")
        .agg(F.min(F.struct("us", "total", order)).alias("first"))
        .select(
            *keys, "level", "at_usd", F.timestamp_micros("first.us").alias("crossed_at"),
            F.col("first.total").alias("spent_usd"),
        )
    )


def daily_overspend(facts: DataFrame, budgets: DataFrame, share: float = 0.5) -> DataFrame:
    """Days on which a tenant spent more than ``share`` of its month's budget."""
    days = facts.groupBy("tenant_id", F.to_date("ts").alias("day")).agg(
        F.sum("cost_usd").alias("spent_usd")
    )
    return (
        days.withColumn("month", F.trunc("day", "month"))
        .join(budgets, ["tenant_id", "month"])
        .filter(F.col("spent_usd") > F.col("limit_usd") * F.lit(str(share)).cast("decimal(6,4)"))
        .select("tenant_id", "day", "spent_usd", "limit_usd")
    )


def error_rate_alerts(
    calls: DataFrame, by: str = "provider", share: float = 0.05, length: int = 5
) -> DataFrame:
    """Windows of ``length`` minutes, sliding by one, whose error share is above the limit."""
    minutes = calls.groupBy(by, F.floor(F.unix_micros("ts") / 60_000_000).alias("minute")).agg(
        F.count(F.lit(1)).alias("calls"), F.count_if("failed").alias("errors")
    )
    spread = minutes.withColumn(
        "window_end", F.explode(F.sequence(F.col("minute"), F.col("minute") + length - 1))
    )
    return (
        spread.groupBy(by, "window_end")
        .agg(F.sum("calls").alias("calls"), F.sum("errors").alias("errors"))
        .filter(F.col("errors") > F.lit(share) * F.col("calls"))
    )


def minute_percentile(calls: DataFrame, by: list[str], value: str, p: float = 0.95) -> DataFrame:
    """Percentile of ``value`` per minute; equal values collapse first."""
    minute = F.floor(F.unix_micros("ts") / 60_000_000).alias("minute")
    counted = calls.groupBy(*by, minute, F.col(value).alias("_x")).agg(F.count(F.lit(1)).alias("_n"))
    return counted.groupBy(*by, "minute").agg(F.percentile("_x", p, F.col("_n")).alias("p"))


def slo_streaks(calls: DataFrame, by: list[str], value: str, slo: float, minutes: int = 10):
    """Runs of at least ``minutes`` consecutive minutes whose p95 is above the objective."""
    high = minute_percentile(calls, by, value).filter(F.col("p") > slo).select(*by, "minute")
    numbered = skew.running(high, by, ["minute"], rank="n", slice=F.floor(F.col("minute") / 1440))
    return (
        numbered.groupBy(*by, (F.col("minute") - F.col("n")).alias("_run"))
        .agg(F.min("minute").alias("first_minute"), F.max("minute").alias("last_minute"),
             F.count(F.lit(1)).alias("length"))
        .filter(F.col("length") >= minutes)
        .drop("_run")
    )


def traffic_spikes(calls: DataFrame, key: str, times: int = 10, back: int = 24) -> DataFrame:
    """Hours in which a key sent at least ``times`` its mean over its previous active hours."""
    hours = calls.groupBy(key, F.floor(F.unix_micros("ts") / 3_600_000_000).alias("hour")).agg(
        F.count(F.lit(1)).alias("calls")
    )
    w = Window.partitionBy(key).orderBy("hour").rowsBetween(-back, -1)
    usual = hours.withColumn("usual", F.avg("calls").over(w))
    return usual.filter(F.col("calls") >= times * F.col("usual"))


def stale_approvals(approvals: DataFrame, now: Column, hours: int = 4) -> DataFrame:
    """Undecided approvals older than ``hours``."""
    age = F.unix_micros(now) - F.unix_micros("requested_at")
    return approvals.filter(F.col("decision").isNull() & (age > hours * 3_600_000_000)).withColumn(
        "age_hours", F.floor(age / 3_600_000_000)
    )


def latency_by_model(calls: DataFrame) -> DataFrame:
    """p50 and p95 of latency and time to first token per model."""
    def of(value: str) -> DataFrame:
        counted = calls.groupBy("model", F.col(value).alias("_x")).agg(F.count(F.lit(1)).alias("_n"))
        return counted.groupBy("model").agg(
            F.round(F.percentile("_x", 0.5, F.col("_n")), 4).alias(f"{value}_p50"),
            F.round(F.percentile("_x", 0.95, F.col("_n")), 4).alias(f"{value}_p95"),
        )

    return of("latency_ms").join(of("ttft_ms"), "model")


def hit_rates(facts: DataFrame, *by: str) -> DataFrame:
    """Share of cache hits and of fallbacks."""
    return facts.groupBy(*by).agg(
        F.count(F.lit(1)).alias("requests"),
        F.round(F.avg(F.col("cache_hit").cast("int")), 6).alias("cache_hit_rate"),
        F.round(F.avg(F.col("fallback").cast("int")), 6).alias("fallback_rate"),
    )


def breaker_intervals(
    calls: DataFrame,
    by: str = "provider",
    share: float = 0.5,
    window_s: int = 30,
    cooldown_s: int = 60,
) -> DataFrame:
    """Intervals in which a provider's breaker is open.

    It opens at the first second whose last ``window_s`` seconds reach the error share, stays open
    for ``cooldown_s`` and may open again after that. That is sequential, but what an hour passes
    on is only how long the breaker stays open into the next hour. Each hour is therefore solved
    for every such value at once; 24 hours make a day's answer for every value, the days of a
    provider are linked, then the hours of each day, and each hour lists its openings.
    """
    hour_s = 3600
    s = F.floor(F.unix_micros("ts") / 1_000_000)
    seconds = calls.groupBy(by, s.alias("s")).agg(
        F.count(F.lit(1)).alias("calls"), F.count_if("failed").alias("errors")
    )
    # The last seconds of an hour are also context of the next one.
    reach = F.array_distinct(F.array(
        F.floor(F.col("s") / hour_s), F.floor((F.col("s") + window_s - 1) / hour_s)
    ))
    recent = Window.partitionBy(by, "hour").orderBy("s").rangeBetween(-(window_s - 1), 0)
    rated = seconds.withColumn("hour", F.explode(reach)).withColumn(
        "_bad", F.sum("errors").over(recent) >= F.lit(share) * F.sum("calls").over(recent)
    )
    hours = (
        rated.filter(F.col("_bad") & (F.col("hour") == F.floor(F.col("s") / hour_s)))
        .groupBy(by, "hour")
        .agg(F.array_sort(F.collect_list((F.col("s") - F.col("hour") * hour_s).cast("int")))
             .alias("_at"))
    )

    def wait(until: Column, at: Column) -> Column:
        return F.when(at >= until, at + cooldown_s).otherwise(until)

    def left_over(carried: Column) -> Column:
        return F.greatest(F.aggregate("_at", carried, wait) - hour_s, F.lit(0))

    passed_on = F.transform(F.sequence(F.lit(0), F.lit(cooldown_s - 1)), left_over)

    def through(parts: str, before: Column, carry: Column):
        """What each of the ``parts`` gets, and what the last passes on, if they start after ``before`` with ``carry``."""

        def link(acc: Column, p: Column) -> Column:
            carried = F.when(p["no"] == acc["no"] + 1, acc["carry"]).otherwise(0)
            return F.struct(
                p["no"].alias("no"), F.get(p["passed_on"], carried).alias("carry"),
                F.concat(acc["seen"], F.array(F.struct(p["no"].alias("no"), carried.alias("carried")))).alias("seen"),
            )

        start = F.struct(
            before.cast("bigint").alias("no"), carry.cast("int").alias("carry"),
            F.array().cast("array<struct<no:bigint,carried:int>>").alias("seen"),
        )
        return F.aggregate(parts, start, link)

    day_of = F.floor(F.col("hour") / 24)
    days = hours.select(by, day_of.alias("day"), F.struct(F.col("hour").cast("bigint").alias("no"), passed_on.alias("passed_on")).alias("_part")).groupBy(
        by, "day"
    ).agg(F.array_sort(F.collect_list("_part")).alias("_hours"))

    def over_day(carry: Column) -> Column:
        end = through("_hours", F.col("day") * 24 - 1, carry)
        return F.when(end["no"] == F.col("day") * 24 + 23, end["carry"]).otherwise(0)

    day_parts = days.select(
        by, F.struct(F.col("day").cast("bigint").alias("no"), F.transform(F.sequence(F.lit(0), F.lit(cooldown_s - 1)), over_day).alias("passed_on")).alias("_part")
    )
    # A number for each day and value in a provider's row: 22,000 a year.
    carried_days = day_parts.groupBy(by).agg(F.array_sort(F.collect_list("_part")).alias("_days")).select(
        by, F.inline(through("_days", F.lit(-2), F.lit(0))["seen"])
    ).select(by, F.col("no").alias("day"), "carried")
    linked = days.join(carried_days, [by, "day"]).select(
        by, F.inline(through("_hours", F.col("day") * 24 - 1, F.col("carried"))["seen"])
    ).select(by, F.col("no").alias("hour"), "carried")

    def open_at(acc: Column, at: Column) -> Column:
        opened = F.struct((at + cooldown_s).alias("until"), F.concat(acc["opens"], F.array(at)).alias("opens"))
        return F.when(at >= acc["until"], opened).otherwise(acc)

    state = F.struct(F.col("carried").alias("until"), F.array().cast("array<int>").alias("opens"))
    opens = F.aggregate("_at", state, open_at, lambda a: a["opens"])
    found = hours.join(linked, [by, "hour"]).select(by, "hour", F.explode(opens).alias("_open"))
    opened_s = F.col("hour") * hour_s + F.col("_open")
    return found.select(by, opened_s.alias("opened_s"), (opened_s + cooldown_s).alias("closes_s"))


def during_open(calls: DataFrame, intervals: DataFrame, by: str = "provider", cooldown_s: int = 60):
    """Add ``breaker_open``: the call falls into an open interval of its provider.

    Time is cut into slices of the cool-down, so the lookup is an equality join: a call's slice and
    the one before hold every interval that can cover it, and intervals do not overlap.
    """
    us = F.unix_micros("ts")
    s = F.floor(us / 1_000_000)
    covering = intervals.select(
        by, "opened_s", "closes_s",
        F.explode(F.sequence(F.floor(F.col("opened_s") / cooldown_s),
                             F.floor((F.col("closes_s") - 1) / cooldown_s))).alias("_slice"),
    ).groupBy(by, "_slice").agg(F.collect_list(F.struct("opened_s", "closes_s")).alias("_open"))
    tagged = calls.withColumn("_slice", F.floor(s / cooldown_s)).join(covering, [by, "_slice"], "left")
    hit = F.exists("_open", lambda i: (i["opened_s"] <= s) & (s < i["closes_s"]))
    return tagged.withColumn("breaker_open", F.coalesce(hit, F.lit(False))).drop("_slice", "_open")


def savings(facts: DataFrame, catalog: DataFrame, baseline_model: str) -> DataFrame:
    """Actual cost against sending every request to one baseline model."""
    from .metering import token_cost

    totals = facts.groupBy("tenant_id").agg(
        F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"),
        F.sum("cost_usd").alias("actual_usd"),
    )
    prices = catalog.select("id", "price_in", "price_out")
    priced = totals.withColumn("id", F.lit(baseline_model)).join(prices, "id")
    baseline = token_cost(F.col("tokens_in"), F.col("tokens_out"))
    return priced.select(
        "tenant_id", "actual_usd", baseline.cast("decimal(18,6)").alias("baseline_usd"),
        percent(baseline - F.col("actual_usd"), baseline).alias("saved_pct"),
    )


def reconcile(metered: DataFrame, reported: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Metered against provider-reported cost per day and model.

    Both sides must be (day, model, cost_usd) totals. A side without a row counts as zero.
    """
    keys = ["day", "model"]
    a = metered.select(*keys, F.col("cost_usd").alias("metered_usd"))
    b = reported.select(*keys, F.col("cost_usd").alias("reported_usd"))
    zero = F.lit(0).cast("decimal(18,6)")
    out = a.join(b, keys, "full").select(
        *keys, F.coalesce("metered_usd", zero).alias("metered_usd"),
        F.coalesce("reported_usd", zero).alias("reported_usd"),
    )
    gap = F.abs(F.col("metered_usd") - F.col("reported_usd"))
    return out.withColumn(
        "within", gap <= F.lit(str(tolerance)).cast("decimal(6,4)") * F.col("reported_usd")
    )


def span_overhead(spans: DataFrame, excluded: tuple[str, ...]) -> DataFrame:
    """Gateway time of each trace: all spans but the model call and retrieval."""
    own = F.when(~F.col("name").isin(*excluded), F.col("duration_ms")).otherwise(0)
    return spans.groupBy("trace_id").agg(F.sum(own).alias("overhead_ms"))
