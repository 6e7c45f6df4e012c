"""Metering and quota queries."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C
from ..constants import USAGE_FIELDS
from ..functions.jsontext import request_tokens
from ..functions.numbers import epoch_text
from ..operators import metering as M
from ..operators import quota as Q
from ..sources import tables as T
from .basis import choose, with_
from .registry import query


def parsed(spark, d):
    return M.read_usage(T.usage_raw(spark, d))


def facts(spark, d):
    return M.usage_facts(parsed(spark, d))


# Gateway log JSON written from events: the first name of each pair is filled on some rows only.
def gateway_logs(spark, d):
    e = T.events(spark, d)
    i = F.col("event_id")

    def sometimes(n, c):
        return F.when(F.pmod(i, F.lit(n)) != 0, c)

    def text(prefix):
        return F.concat(F.lit(prefix), i.cast("string"))

    slo = F.struct(
        text("slo-").alias("id"),
        sometimes(4, text("trace-")).alias("trace_id"),
        F.lit("group").alias("model_group"),
        sometimes(5, F.col("model")).alias("model"),
        F.when(F.pmod(i, F.lit(6)) == 0, "").otherwise("acompletion").alias("call_type"),
        sometimes(7, F.col("tokens_in")).alias("prompt_tokens"),
        F.col("tokens_out").alias("completion_tokens"),
        F.when(F.pmod(i, F.lit(8)) == 0, 0).otherwise(F.col("cost_micros")).alias("response_cost"),
        (F.col("event_type") == "view").alias("cache_hit"),
        (F.floor(F.col("us") / 1_000_000) - 1).alias("startTime"),
        F.floor(F.col("us") / 1_000_000).alias("endTime"),
        F.struct(
            F.col("tenant_id").alias("user_api_key_team_id"),
            F.col("slug").alias("user_api_key_team_alias"),
            sometimes(9, text("hash-")).alias("user_api_key_hash"),
            F.col("slug").alias("user_api_key_alias"),
        ).alias("metadata"),
    )
    payload = F.struct(
        sometimes(3, text("call-")).alias("litellm_call_id"),
        F.lit("outer-model").alias("model"),
        F.lit("outer-type").alias("call_type"),
        F.lit(5).alias("response_cost"),
        (F.pmod(i, F.lit(2)) == 0).alias("stream"),
        F.when(F.pmod(i, F.lit(10)) != 0, slo).alias("standard_logging_object"),
    )
    return e.select("event_id", F.to_json(payload).alias("payload"))


_SLO = "event_id % 10 <> 0"


@query(
    "m01_normalise_gateway_log",
    with_("ev", then=f"""SELECT event_id,
    CASE WHEN event_id % 3 <> 0 THEN 'call-' || event_id WHEN {_SLO} THEN 'slo-' || event_id
      ELSE '' END AS call_id,
    CASE WHEN {_SLO} AND event_id % 4 <> 0 THEN 'trace-' || event_id ELSE '' END AS trace_id,
    CASE WHEN {_SLO} THEN tenant_id ELSE '' END AS team_id,
    CASE WHEN {_SLO} THEN slug ELSE '' END AS team_alias,
    CASE WHEN {_SLO} AND event_id % 9 <> 0 THEN 'hash-' || event_id ELSE '' END AS key_hash,
    CASE WHEN {_SLO} THEN slug ELSE '' END AS key_alias,
    CASE WHEN {_SLO} THEN 'group' ELSE '' END AS model_group,
    CASE WHEN {_SLO} AND event_id % 5 <> 0 THEN model ELSE 'outer-model' END AS model,
    CASE WHEN {_SLO} AND event_id % 6 <> 0 THEN 'acompletion' ELSE 'outer-type' END AS call_type,
    CASE WHEN {_SLO} AND event_id % 7 <> 0 THEN tokens_in ELSE 0 END::VARCHAR AS tokens_in,
    CASE WHEN {_SLO} THEN tokens_out ELSE 0 END::VARCHAR AS tokens_out,
    CASE WHEN {_SLO} AND event_id % 8 <> 0 AND cost_micros <> 0 THEN cost_micros ELSE 5
      END::VARCHAR AS cost_usd,
    CASE WHEN {_SLO} AND event_type = 'view' THEN 'True' ELSE 'False' END AS cache_hit,
    CASE WHEN event_id % 2 = 0 THEN 'True' ELSE 'False' END AS stream,
    CASE WHEN {_SLO} THEN (us // 1000000 - 1)::VARCHAR ELSE '' END AS start_time,
    CASE WHEN {_SLO} THEN (us // 1000000)::VARCHAR ELSE '' END AS end_time FROM ev"""),
)
def normalise(spark, d):
    df = M.normalise_log(gateway_logs(spark, d))
    return df.select("event_id", *[F.element_at("fields", F.lit(n)).alias(n) for n in USAGE_FIELDS])


_COPIES = "SELECT *, unnest(CASE WHEN event_id % 50 = 0 THEN [1, 2] ELSE [1] END) AS c FROM usage"


@query(
    "m02_read_usage_records",
    with_("usage", then=f"""SELECT event_id::VARCHAR AS stream_id, reason,
    CASE WHEN reason IS NULL THEN us END AS ts_us,
    CASE WHEN reason IS NULL THEN tenant_id END AS tenant_id,
    CASE WHEN reason IS NULL THEN endpoint END AS endpoint,
    CASE WHEN reason IS NULL THEN model END AS model,
    CASE WHEN reason IS NULL THEN tokens_in END AS tokens_in,
    CASE WHEN reason IS NULL THEN tokens_out END AS tokens_out,
    CASE WHEN reason IS NULL THEN cost_micros END AS cost_micros,
    CASE WHEN reason IS NULL THEN latency_ms END AS latency_ms,
    CASE WHEN reason IS NULL THEN cache_hit END AS cache_hit,
    CASE WHEN reason IS NULL THEN trace_id END AS trace_id FROM ({_COPIES})"""),
)
def read_usage(spark, d):
    df = parsed(spark, d)
    ok = F.col("reason").isNull()
    values = {
        "ts_us": F.unix_micros("ts"), "cost_micros": (F.col("cost_usd") * 1_000_000).cast("bigint"),
        **{c: F.col(c) for c in ("tenant_id", "endpoint", "model", "tokens_in", "tokens_out",
                                 "latency_ms", "cache_hit", "trace_id")},
    }
    return df.select("stream_id", "reason", *[F.when(ok, v).alias(k) for k, v in values.items()])


@query(
    "m09_refusals_by_reason",
    with_("usage", then=f"""SELECT coalesce(reason, 'ok') AS reason, count(*) AS records
    FROM ({_COPIES}) GROUP BY 1"""),
)
def refusals(spark, d):
    return parsed(spark, d).groupBy(F.coalesce("reason", F.lit("ok")).alias("reason")).agg(
        F.count(F.lit(1)).alias("records")
    )


@query(
    "m11_usage_facts",
    with_("facts", then="""SELECT event_id::VARCHAR AS stream_id,
    strftime(make_timestamp(us), '%Y-%m-%d %H:%M:%S.%f') AS ts, tenant_id, endpoint, model,
    tokens_in, tokens_out, 0::BIGINT AS cache_read, 0::BIGINT AS cache_write,
    cost_micros / 1000000 AS cost_usd, latency_ms, cache_hit, FALSE AS fallback,
    200::BIGINT AS status, trace_id FROM facts"""),
)
def usage_facts(spark, d):
    return facts(spark, d)


@query(
    "s07_usage_dead_letters",
    with_("usage", then=f"""SELECT event_id::VARCHAR AS source_stream_id, reason,
    CASE WHEN event_id % 97 = 0 THEN 'cskh' ELSE tenant_id END AS team_id,
    CASE WHEN event_id % 89 = 0 THEN '-1' ELSE tokens_in::VARCHAR END AS tokens_in
    FROM ({_COPIES}) WHERE reason IS NOT NULL"""),
)
def dead_letters(spark, d):
    return M.usage_dead_letters(parsed(spark, d)).select(
        "source_stream_id", "reason", F.element_at("fields", F.lit("team_id")).alias("team_id"),
        F.element_at("fields", F.lit("tokens_in")).alias("tokens_in"),
    )


@query(
    "s07_dead_letter_retention",
    with_("usage", then="""SELECT event_id::VARCHAR AS source_stream_id, us AS received_us,
    us >= epoch_us(TIMESTAMP '2024-01-16') AS kept FROM usage WHERE reason IS NOT NULL"""),
)
def dead_letter_retention(spark, d):
    """Letters by age; what is to be removed is listed too."""
    since = F.unix_micros(F.lit("2024-01-16 00:00:00").cast("timestamp"))
    letters = parsed(spark, d).filter("reason IS NOT NULL").groupBy(F.col("stream_id").alias("source_stream_id")).agg(
        F.unix_micros(F.min("ts")).alias("received_us")
    )
    return M.retention(letters, "received_us", since)


@query(
    "m12_exactly_once_counts",
    with_("usage", then=f"""SELECT slug, count(*) AS received,
    count(*) FILTER (reason IS NULL) AS accepted,
    count(DISTINCT event_id) FILTER (reason IS NULL) AS stored FROM ({_COPIES}) GROUP BY slug"""),
)
def exactly_once(spark, d):
    records = parsed(spark, d)
    slug = T.tenants(spark).select("tenant_id", "slug")
    # A faulty team id names no tenant, so the tenant of every record comes from its event.
    owner = T.events(spark, d).select(F.col("event_id").cast("string").alias("stream_id"), "slug")
    per_id = records.groupBy("stream_id").agg(
        F.count(F.lit(1)).alias("received"), F.count_if(F.col("reason").isNull()).alias("accepted")
    )
    stored = M.usage_facts(records).join(F.broadcast(slug), "tenant_id").groupBy("slug").agg(
        F.count(F.lit(1)).alias("stored")
    )
    seen = per_id.join(owner, "stream_id").groupBy("slug").agg(
        F.sum("received").alias("received"), F.sum("accepted").alias("accepted")
    )
    return seen.join(stored, "slug")


def provider_usage(spark, d):
    """Provider reports: a fifth of the prompt came from the cache."""
    e = T.events(spark, d)
    hit = F.floor(F.col("tokens_in") / 5).cast("bigint")
    separate = F.pmod("event_id", F.lit(3)) == 2
    return e.select(
        "event_id", "model", F.when(separate, "anthropic").otherwise("openai").alias("provider"),
        F.when(separate, F.col("tokens_in") - hit).otherwise(F.col("tokens_in"))
        .alias("input_reported"),
        F.when(F.pmod("event_id", F.lit(4)) != 0, hit).alias("cache_read_reported"),
        F.when(separate, F.pmod("event_id", F.lit(7))).alias("cache_write_reported"),
        F.col("tokens_out").alias("output_reported"),
    )


_PROVIDER = """SELECT event_id, model, slug, event_id % 3 = 2 AS sep,
    CASE WHEN event_id % 4 <> 0 THEN tokens_in // 5 ELSE 0 END AS cache_read,
    CASE WHEN event_id % 3 = 2 THEN event_id % 7 ELSE 0 END AS cache_write,
    CASE WHEN event_id % 3 = 2 THEN tokens_in - tokens_in // 5
      WHEN event_id % 4 <> 0 THEN tokens_in - tokens_in // 5 ELSE tokens_in END AS input,
    tokens_out AS output FROM ev"""


@query(
    "m13_normalise_provider_usage",
    with_("ev", then=f"SELECT event_id, input, output, cache_read, cache_write FROM ({_PROVIDER})"),
)
def provider_normalised(spark, d):
    return M.normalise_provider_usage(provider_usage(spark, d)).select(
        "event_id", "input", "output", "cache_read", "cache_write"
    )


@query(
    "m14_cost_with_cache_prices",
    # Prices in thousandths keep the sum a whole number: multipliers are 0.100 and 1.250.
    with_("ev", "catalog", then=f"""SELECT model, count(*) AS calls,
    sum(input * price_in * 1000 + cache_read * price_in * 100 + cache_write * price_in * 1250
      + output * price_out * 1000)::BIGINT AS cost_nano FROM ({_PROVIDER}) p
    LEFT JOIN catalog c ON c.id = p.model GROUP BY model"""),
)
def cost_with_cache(spark, d):
    priced = M.normalise_provider_usage(provider_usage(spark, d)).join(
        T.catalog(spark).drop("provider").withColumnRenamed("id", "model"), "model", "left"
    )
    nano = (M.cost_usd() * 1_000_000_000).cast("decimal(28,0)").cast("bigint")
    return priced.groupBy("model").agg(
        F.count(F.lit(1)).alias("calls"), F.sum(nano).alias("cost_nano")
    )


@query(
    "m15_cost_check",
    with_("facts", "catalog", then="""SELECT event_id::VARCHAR AS stream_id,
    (tokens_in * price_in + tokens_out * price_out)::BIGINT AS expected_micros,
    CASE WHEN id IS NULL THEN 'unpriced' WHEN abs(cost_micros - (tokens_in * price_in + tokens_out * price_out)) * 100
      <= tokens_in * price_in + tokens_out * price_out THEN 'within' ELSE 'outside' END AS outcome
    FROM facts LEFT JOIN (SELECT * FROM catalog WHERE id <> 'mock-claude') ON id = model"""),
)
def cost_check(spark, d):
    """One model is missing from the price list."""
    known = T.catalog(spark).filter("id <> 'mock-claude'")
    return M.check_cost(facts(spark, d), known).select(
        "stream_id", (F.col("expected_usd") * 1_000_000).cast("bigint").alias("expected_micros"), "outcome",
    )


@query(
    "m16_estimate_before_call",
    with_("ev", "catalog", then="""SELECT event_id,
    (tokens_in * price_in + (256 + event_id % 100) * price_out)::BIGINT AS estimate_micros
    FROM ev LEFT JOIN catalog ON id = model"""),
)
def estimate(spark, d):
    e = T.events(spark, d).join(T.catalog(spark).withColumnRenamed("id", "model"), "model", "left")
    cost = M.estimate_before_call(F.col("tokens_in"), 256 + F.pmod("event_id", F.lit(100)))
    return e.select("event_id", (cost * 1_000_000).cast("bigint").alias("estimate_micros"))


# --- quotas ----------------------------------------------------------------------------------

def quota_requests(spark, d):
    """Traffic is sparse, so a quota minute spans an hour of events; limits shrink with it."""
    return T.events(spark, d).select(
        F.col("event_id").alias("request_id"),
        F.col("slug").alias("tenant"),
        Q.minute_bucket(F.floor(F.col("us") / 60_000_000)).alias("bucket"),
        F.col("us").alias("ts"),
        (F.col("tokens_in") + 256).alias("tokens"),
        F.lit(4).cast("bigint").alias("rpm"),
        F.lit(2000).cast("bigint").alias("tpm"),
    )


_REPLAY = """SELECT *, sum(CASE WHEN rpm_count <= 4 THEN tokens END)
      OVER (PARTITION BY slug, bucket ORDER BY us, event_id) AS tpm_running FROM (
    SELECT event_id, slug, us, (us // 60000000) // 60 AS bucket, tokens_in + 256 AS tokens,
      row_number() OVER (PARTITION BY slug, (us // 60000000) // 60 ORDER BY us, event_id)
        AS rpm_count FROM ev)"""


@query(
    "q06_quota_replay",
    with_("ev", then=f"""SELECT event_id AS request_id, bucket, rpm_count,
    CASE WHEN rpm_count <= 4 THEN tpm_running END::BIGINT AS tpm_count,
    CASE WHEN rpm_count > 4 THEN 'rpm' WHEN tpm_running > 2000 THEN 'tpm' END AS reason,
    rpm_count <= 4 AND tpm_running <= 2000 AS admitted FROM ({_REPLAY})"""),
)
def quota_replay(spark, d):
    return Q.replay(quota_requests(spark, d), slice=F.floor(F.col("ts") / 1_000_000)).select(
        "request_id", "bucket", "rpm_count", "tpm_count", "reason", "admitted"
    )


@query(
    "q04_rpm_counts",
    with_("ev", then=f"""SELECT slug AS tenant, bucket, count(*) AS requests,
    count(*) FILTER (rpm_count <= 4) AS passed_rpm,
    count(*) FILTER (rpm_count <= 4 AND tpm_running <= 2000) AS admitted FROM ({_REPLAY})
    GROUP BY slug, bucket"""),
)
def rpm_counts(spark, d):
    return Q.replay(quota_requests(spark, d), slice=F.floor(F.col("ts") / 1_000_000)).groupBy("tenant", "bucket").agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(F.col("rpm_count") <= F.col("rpm")).alias("passed_rpm"),
        F.count_if("admitted").alias("admitted"),
    )


@query(
    "q05_tpm_counts",
    with_("ev", then=f"""SELECT slug AS tenant, coalesce(
    CASE WHEN rpm_count > 4 THEN 'rpm' WHEN tpm_running > 2000 THEN 'tpm' END, 'admitted')
      AS outcome, count(*) AS requests, sum(tokens)::BIGINT AS tokens FROM ({_REPLAY}) GROUP BY 1, 2"""),
)
def tpm_counts(spark, d):
    out = Q.replay(quota_requests(spark, d), slice=F.floor(F.col("ts") / 1_000_000))
    return out.groupBy("tenant", F.coalesce("reason", F.lit("admitted")).alias("outcome")).agg(
        F.count(F.lit(1)).alias("requests"), F.sum("tokens").alias("tokens")
    )


def key_metadata(spark, d):
    """Key metadata as JSON: limits are missing, boolean, zero, text or numbers."""
    i = F.col("event_id")
    rpm = F.get(
        F.array(*[F.lit(x) for x in ("60", "0", "true", None, "\"30\"", "\"wrong\"", "null", "60.0", "1e2")]),
        F.pmod(i, F.lit(9)).cast("int"),
    )
    tenant = F.when(F.pmod(i, F.lit(5)) == 0, F.lit(" ")).otherwise(F.concat(F.lit(" "), "slug"))
    body = F.concat_ws(
        ", ", F.concat(F.lit('"tenant": "'), tenant, F.lit('"')),
        F.concat(F.lit('"rpm_limit": '), rpm), F.lit('"tpm_limit": 1000'),
    )
    return T.events(spark, d).select("event_id", F.concat(F.lit("{"), body, F.lit("}")).alias("metadata"))


@query(
    "q01_rate_policy",
    with_("ev", then="""SELECT event_id,
    CASE WHEN event_id % 5 = 0 OR event_id % 9 IN (3, 6) THEN 'none'
      WHEN event_id % 9 IN (0, 4) THEN 'active' ELSE 'invalid' END AS policy,
    CASE WHEN event_id % 5 = 0 OR event_id % 9 IN (3, 6) THEN NULL ELSE slug END AS tenant,
    CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 9 = 0 THEN 60 WHEN event_id % 9 = 4 THEN 30
      END::BIGINT AS rpm,
    CASE WHEN event_id % 5 = 0 OR event_id % 9 IN (3, 6) THEN NULL ELSE 1000 END::BIGINT AS tpm
    FROM ev"""),
)
def rate_policy(spark, d):
    return Q.rate_policy(key_metadata(spark, d)).select("event_id", "policy", "tenant", "rpm", "tpm")


def _max_tokens_json():
    options = ("null", "0", '"12"', "-5", "true", "2.7", '"x"', "40")
    return T.pick(options, F.col("turn") + F.col("conv_id"))


_MAX = ("256", "256", "12", "0", "1", "2", "256", "40")


@query(
    "q02_token_estimate",
    with_("turns", then="""SELECT conv_id, turn, greatest(1, (chars + 3) // 4)::BIGINT
      + [256, 256, 12, 0, 1, 2, 256, 40][(turn + conv_id) % 8 + 1] AS tokens FROM (
    SELECT conv_id, turn, 2 + length('"messages": [{"content": ') + length(to_json(text)::VARCHAR)
      + length(', "role": ') + length(role) + 2 + length('}]') AS chars FROM turns)"""),
)
def token_estimate(spark, d):
    body = F.concat(
        F.lit('{"model": "m", "messages": ['),
        F.to_json(F.struct("role", F.col("text").alias("content"))),
        F.lit('], "max_tokens": '), _max_tokens_json(), F.lit("}"),
    )
    return T.turns(spark, d).select("conv_id", "turn", request_tokens(body).alias("tokens"))


@query(
    "q03_counter_keys",
    with_("ev", then="""SELECT event_id, us // 60000000 AS bucket,
    'rate:rpm:' || sha256(slug)[1:24] || ':' || (us // 60000000) AS counter_key FROM ev"""),
)
def counter_keys(spark, d):
    bucket = Q.minute_bucket(F.col("us") / 1_000_000)
    return T.events(spark, d).select(
        "event_id", bucket.alias("bucket"),
        Q.counter_key(F.col("slug"), "rpm", bucket).alias("counter_key"),
    )


@query(
    "t05_minute_counters",
    with_("ev", then="""SELECT slug, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S.%f') AS minute,
    count(*) AS requests, sum(tokens_in)::BIGINT AS tokens FROM ev GROUP BY 1, 2"""),
)
def minute_counters(spark, d):
    w = F.window("ts", "1 minute")
    return T.events(spark, d).groupBy("slug", w).agg(
        F.count(F.lit(1)).alias("requests"), F.sum("tokens_in").alias("tokens")
    ).select("slug", F.col("window.start").alias("minute"), "requests", "tokens")


# --- one field of a usage record at a time -----------------------------------------------------

def valid_fields() -> dict[str, Column]:
    """Fields of a valid usage record of an event."""
    i, us = F.col("event_id"), F.col("us")
    return {
        "call_id": F.concat(F.lit("call-"), i.cast("string")), "trace_id": F.lit("trace"), "team_id": F.col("tenant_id"),
        "model": F.col("model"), "call_type": F.lit("acompletion"), "tokens_in": F.lit("1"), "tokens_out": F.lit("2"),
        "cost_usd": F.lit("0.5"), "cache_hit": F.lit("False"), "start_time": epoch_text(us - 1_000_000),
        "end_time": epoch_text(us),
    }


def _read_fields(events, values: dict[str, Column]):
    """The events as usage records of these fields, absent ones left out, read."""
    written = events.select("event_id", "us", *[v.alias(f"_{k}") for k, v in values.items()])
    fields = F.create_map(*[x for k in values for x in (F.lit(k), F.col(f"_{k}"))])
    absent = reduce(or_, [F.col(f"_{k}").isNull() for k in values])
    records = written.select(
        F.col("event_id").cast("string").alias("stream_id"),
        F.when(absent, F.map_filter(fields, lambda k, v: v.isNotNull())).otherwise(fields).alias("fields"), "event_id", "us",
    )
    return M.read_usage(records)


def one_field(spark, d, name: str, options, **others):
    """Valid usage records of all events, but for field ``name``, which takes the options in turn."""
    given = F.get(F.array(*[o if isinstance(o, Column) else F.lit(o).cast("string") for o in options]),
                  F.pmod("event_id", F.lit(len(options))).cast("int"))
    return _read_fields(T.events(spark, d), valid_fields() | others | {name: given})


def _expected(value: str, results, reasons) -> str:
    """SQL: the value and reason of each option in turn."""
    return with_("ev", then=f"""SELECT event_id, {choose(results, 'event_id')} AS {value},
    {choose(reasons, 'event_id')} AS reason FROM ev""")


def _shown(df, name: str, value):
    return df.select("event_id", F.when(F.col("reason").isNull(), value).alias(name), "reason")


_NOT, _NEG = "tokens_in" + C.MSG_NOT_INT, "tokens_in" + C.MSG_NEGATIVE


@query("m03_whole_numbers", _expected(
    "tokens_in", (12, 7, 0, None, None, None, None, None, 5, 2147483647, None),
    (None, None, None, _NOT, _NEG, _NOT, _NOT, _NOT, None, None, "tokens_in" + C.MSG_INVALID)))
def whole_numbers(spark, d):
    df = one_field(spark, d, "tokens_in", ("12", " 7 ", None, "", "-3", "1.5", "x", "1_0", "+5", "2147483647", "2147483648"))
    return _shown(df, "tokens_in", F.col("tokens_in"))


@query("m04_costs", _expected(
    "cost_micros", (250000, 1000, 0, None, None, None, None, 2000000, 999999999999, None, None),
    (None, None, None, "cost_usd" + C.MSG_INVALID, "cost_usd" + C.MSG_INVALID, "cost_usd" + C.MSG_INVALID,
     "cost_usd" + C.MSG_NOT_NUMBER, None, None, "cost_usd" + C.MSG_INVALID, "cost_usd" + C.MSG_INVALID)))
def costs(spark, d):
    df = one_field(spark, d, "cost_usd", ("0.25", "1e-3", None, "-1", "nan", "inf", "abc", " 2 ", "999999.9999994", "999999.9999996", "1234567.5"))
    return _shown(df, "cost_micros", (F.col("cost_usd") * 1_000_000).cast("bigint"))


@query("m05_truth", with_("ev", then="SELECT event_id, event_id % 8 IN (0, 1, 2, 6) AS cache_hit FROM ev"))
def truth(spark, d):
    df = one_field(spark, d, "cache_hit", ("True", "1", "yes", "no", "", None, " TRUE ", "t"))
    return df.select("event_id", "cache_hit")


@query("m06_event_time", with_("ev", then=f"""SELECT event_id, CASE WHEN event_id % 7 = 0 THEN us END AS ts_us,
    {choose((None, C.MSG_END_INVALID, C.MSG_END_INVALID, C.MSG_MISSING + 'end_time', C.MSG_MISSING + 'end_time',
             C.MSG_END_NOT_TS, C.MSG_END_INVALID), 'event_id')} AS reason FROM ev"""))
def event_time(spark, d):
    df = one_field(spark, d, "end_time", (epoch_text(F.col("us")), "0", "-5", "", None, "abc", "nan"))
    return _shown(df, "ts_us", F.unix_micros("ts"))


@query("m07_latency", _expected("latency_ms", (1250, 0, None, None), (None, None, C.MSG_LATENCY, C.MSG_LATENCY)))
def latency(spark, d):
    us = F.col("us")
    df = one_field(spark, d, "start_time", (epoch_text(us - 1_250_000), epoch_text(us + 3_000_000), "x", None))
    return _shown(df, "latency_ms", F.col("latency_ms"))


@query("m08_endpoints", with_("ev", then=f"""SELECT event_id, {choose(
    ('/v1/embeddings', '/v1/messages', *['/v1/chat/completions'] * 3), 'event_id')} AS endpoint,
    NULL::VARCHAR AS reason FROM ev"""))
def endpoints(spark, d):
    df = one_field(spark, d, "call_type", ("aembedding", "anthropic_messages", "acompletion", "", None))
    return _shown(df, "endpoint", F.col("endpoint"))


@query("m10_trace_ids", with_("ev", then=f"""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 't'
    WHEN event_id % 2 = 0 THEN 'call-' || event_id END AS trace_id,
    CASE WHEN event_id % 3 <> 0 AND event_id % 2 = 1 THEN '{C.MSG_MISSING}call_id' END AS reason FROM ev"""))
def trace_ids(spark, d):
    i = F.col("event_id")
    call = F.when(F.pmod(i, F.lit(2)) == 0, F.concat(F.lit("call-"), i.cast("string"))).otherwise(" ")
    return _shown(one_field(spark, d, "trace_id", ("t", "", None), call_id=call), "trace_id", F.col("trace_id"))


@query("m09_every_refusal", with_("ev", then=f"""SELECT reason, sum(records)::BIGINT AS records FROM (SELECT unnest([{', '.join(f"'{m}'" for m in (
    C.MSG_TEAM, C.MSG_MISSING + 'end_time', C.MSG_END_NOT_TS, C.MSG_END_INVALID, C.MSG_MISSING + 'model',
    'tokens_in' + C.MSG_NOT_INT, 'tokens_in' + C.MSG_NEGATIVE, 'tokens_out' + C.MSG_NOT_INT, 'tokens_out' + C.MSG_NEGATIVE,
    'tokens_in' + C.MSG_INVALID, 'tokens_out' + C.MSG_INVALID, 'cost_usd' + C.MSG_INVALID,
    'cost_usd' + C.MSG_NOT_NUMBER, 'cost_usd' + C.MSG_INVALID, C.MSG_LATENCY, C.MSG_MISSING + 'call_id'))}]) AS reason,
    count(*) AS records FROM ev) GROUP BY 1"""))
def every_refusal(spark, d):
    """All fifteen reasons, each over all events; numbers that the fact table cannot hold have theirs."""
    wrong = (("team_id", "x"), ("end_time", ""), ("end_time", "x"), ("end_time", "0"), ("model", " "), ("tokens_in", "x"),
             ("tokens_in", "-1"), ("tokens_out", "x"), ("tokens_out", "-1"), ("cost_usd", "x"), ("cost_usd", "-1"),
             ("start_time", "x"), ("trace_id", None), ("tokens_in", "3000000000"), ("tokens_out", "2147483648"),
             ("cost_usd", "1000000"))
    each = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(v).cast("string").alias("value")) for n, v in wrong])
    # A few files of narrow events become sixteen times the records: dealt out to all cores first.
    narrow = T.events(spark, d).select("event_id", "us", "tenant_id", "model")
    events = narrow.repartition(2 * spark.sparkContext.defaultParallelism).select("*", F.inline(each))

    def wrongly(name: str, value: Column) -> Column:
        return F.when(F.col("name") == name, F.col("value")).otherwise(value)

    values = {k: wrongly(k, v) for k, v in valid_fields().items()}
    values["call_id"] = F.when(F.col("name") == "trace_id", F.lit(" ")).otherwise(values["call_id"])
    return _read_fields(events, values).groupBy("reason").agg(F.count(F.lit(1)).alias("records"))
