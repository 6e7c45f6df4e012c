"""Usage metering: normalise gateway logs, read usage records, dedupe, price."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (
    DEFAULT_ENDPOINT, ENDPOINTS, MSG_END_INVALID, MSG_END_NOT_TS, MSG_INVALID, MSG_LATENCY,
    MSG_MISSING, MSG_NEGATIVE, MSG_NOT_INT, MSG_NOT_NUMBER, MSG_TEAM, USAGE_FIELDS,
)
from ..functions.numbers import (
    epoch_timestamp, is_number, read_bool, read_decimal, read_double, read_int, read_uuid,
)
from ..functions.text import blank_to_null, computed_once

_LOG = (
    "litellm_call_id string, model string, call_type string, response_cost string, stream string, "
    "standard_logging_object struct<id:string,trace_id:string,model_group:string,model:string,"
    "call_type:string,prompt_tokens:string,completion_tokens:string,response_cost:string,"
    "cache_hit:string,startTime:string,endTime:string,metadata:struct<"
    "user_api_key_team_id:string,user_api_key_team_alias:string,user_api_key_hash:string,"
    "user_api_key_alias:string>>"
)


def normalise_log(logs: DataFrame, payload: str = "payload") -> DataFrame:
    """Nested gateway log JSON -> the flat string fields of a usage record."""
    read = computed_once(logs, {"_log": F.from_json(F.col(payload), _LOG)})
    p = F.col("_log")
    slo = p["standard_logging_object"]
    meta = slo["metadata"]

    def first(*options: Column) -> Column:
        filled = [F.nullif(o, F.lit("")) for o in options]
        return F.coalesce(*filled, F.lit(""))

    def nonzero(number: Column) -> Column:
        return F.when(number.try_cast("double") != 0, number)

    def truth(flag: Column) -> Column:
        no = F.coalesce(F.lower(flag), F.lit("")).isin("", "false", "0", "0.0")
        return F.when(no, "False").otherwise("True")

    values = {
        "call_id": first(p["litellm_call_id"], slo["id"]),
        "trace_id": first(slo["trace_id"]),
        "team_id": first(meta["user_api_key_team_id"]),
        "team_alias": first(meta["user_api_key_team_alias"]),
        "key_hash": first(meta["user_api_key_hash"]),
        "key_alias": first(meta["user_api_key_alias"]),
        "model_group": first(slo["model_group"]),
        "model": first(slo["model"], p["model"]),
        "call_type": first(slo["call_type"], p["call_type"]),
        "tokens_in": F.coalesce(F.nullif(slo["prompt_tokens"], F.lit("")), F.lit("0")),
        "tokens_out": F.coalesce(F.nullif(slo["completion_tokens"], F.lit("")), F.lit("0")),
        "cost_usd": F.coalesce(
            nonzero(slo["response_cost"]), nonzero(p["response_cost"]), F.lit("0")
        ),
        "cache_hit": truth(slo["cache_hit"]),
        "stream": truth(p["stream"]),
        "start_time": first(slo["startTime"]),
        "end_time": first(slo["endTime"]),
    }
    fields = F.create_map(*[x for n in USAGE_FIELDS for x in (F.lit(n), values[n])])
    return read.withColumn("fields", fields).drop("_log")


def endpoint(call_type: Column) -> Column:
    named = F
    for call, path in ENDPOINTS.items():
        named = named.when(call_type == call, path)
    return named.otherwise(DEFAULT_ENDPOINT)


def latency_ms(start: Column, end: Column) -> Column:
    return F.greatest(F.lit(0.0), F.rint((end - start) * 1000)).cast("bigint")


#: Largest count of the fact table's 32-bit columns.
MOST_TOKENS = 2**31 - 1


def read_usage(records: DataFrame, fields: str = "fields") -> DataFrame:
    """Read string records; ``reason`` holds the first refusal, NULL for a valid record."""

    def raw(name: str, absent: str | None = None) -> Column:
        value = F.try_element_at(F.col(fields), F.lit(name))
        return value if absent is None else F.coalesce(value, F.lit(absent))

    # The generator of the next step keeps these from being copied into their uses.
    t = records.select(
        "*",
        raw("team_id").alias("_team"),
        raw("end_time").alias("_end"),
        raw("start_time").alias("_start"),
        raw("model").alias("_model"),
        raw("tokens_in", "0").alias("_in"),
        raw("tokens_out", "0").alias("_out"),
        raw("cost_usd", "0").alias("_cost"),
        raw("call_type").alias("_call"),
        raw("cache_hit").alias("_hit"),
        raw("trace_id").alias("_trace"),
    )
    v = computed_once(t, {
        "tenant_id": read_uuid(F.col("_team")),
        "model": blank_to_null(F.col("_model")),
        "tokens_in": read_int(F.col("_in")),
        "tokens_out": read_int(F.col("_out")),
        "_usd": read_decimal(F.col("_cost")),
        "_began": read_double(F.col("_start")),
        "_ended": read_double(F.col("_end")),
        "_id": F.when(F.length("_trace") > 0, F.col("_trace"))
        .otherwise(blank_to_null(raw("call_id"))),
    })

    def missing(c: Column) -> Column:
        return F.coalesce(c, F.lit(False))

    # What the fact table can hold; a cost beyond it is refused instead of stored as NULL.
    stored_usd = F.col("_usd").try_cast("decimal(12,6)")
    checks = [
        (F.col("tenant_id").isNull(), MSG_TEAM),
        (
            F.col("_ended").isNull() & blank_to_null(F.col("_end")).isNull(),
            MSG_MISSING + "end_time",
        ),
        (F.col("_ended").isNull() & ~is_number(F.col("_end")), MSG_END_NOT_TS),
        (~missing(F.col("_ended") > 0), MSG_END_INVALID),
        (F.col("model").isNull(), MSG_MISSING + "model"),
    ]
    for name in ("tokens_in", "tokens_out"):
        checks += [
            (F.col(name).isNull(), name + MSG_NOT_INT), (F.col(name) < 0, name + MSG_NEGATIVE),
            (F.col(name) > MOST_TOKENS, name + MSG_INVALID),
        ]
    checks += [
        (F.col("_usd").isNull() & ~is_number(F.col("_cost")), "cost_usd" + MSG_NOT_NUMBER),
        (~missing((F.col("_usd") >= 0) & stored_usd.isNotNull()), "cost_usd" + MSG_INVALID),
        (F.col("_began").isNull(), MSG_LATENCY),
        (F.col("_id").isNull(), MSG_MISSING + "call_id"),
    ]
    reason = F.coalesce(*[F.when(bad, F.lit(text)) for bad, text in checks])
    return v.select(
        *[F.col(c) for c in records.columns],
        reason.alias("reason"),
        epoch_timestamp(F.col("_ended")).alias("ts"),
        "tenant_id",
        endpoint(F.col("_call")).alias("endpoint"),
        "model",
        "tokens_in",
        "tokens_out",
        stored_usd.alias("cost_usd"),
        latency_ms(F.col("_began"), F.col("_ended")).alias("latency_ms"),
        read_bool(F.col("_hit")).alias("cache_hit"),
        F.col("_id").alias("trace_id"),
    )


FACT_COLUMNS = (
    "stream_id", "ts", "tenant_id", "endpoint", "model", "tokens_in", "tokens_out", "cache_read",
    "cache_write", "cost_usd", "latency_ms", "cache_hit", "fallback", "status", "trace_id",
)


def usage_facts(parsed: DataFrame) -> DataFrame:
    """Valid records once per stream id, the earliest one, with the fact table's default columns."""
    rest = [c for c in FACT_COLUMNS if c != "stream_id"]
    rows = (
        parsed.filter(F.col("reason").isNull())
        .select(
            "*",
            F.lit(0).alias("cache_read"),
            F.lit(0).alias("cache_write"),
            F.lit(False).alias("fallback"),
            F.lit(200).cast("smallint").alias("status"),
        )
    )
    first = rows.groupBy("stream_id").agg(F.min(F.struct(*rest)).alias("first"))
    return first.select("stream_id", "first.*")


def usage_dead_letters(parsed: DataFrame, fields: str = "fields") -> DataFrame:
    """Refused records with their reason and original fields."""
    return parsed.filter(F.col("reason").isNotNull()).select(
        F.col("stream_id").alias("source_stream_id"), "reason", F.col(fields).alias("fields")
    )


def retention(letters: DataFrame, at: str, since: Column, most: int | None = None) -> DataFrame:
    """Dead letters with ``kept``: received at ``since`` or later.

    ``most`` is an optional bound on the kept rows, the newest first; without it age alone decides.
    Removed letters stay in the result, so that what goes is counted before it is deleted.
    """
    marked = letters.withColumn("kept", F.coalesce(F.col(at) >= since, F.lit(False)))
    if most is None:
        return marked
    newest = [F.col(at).desc(), F.col("source_stream_id").desc()]
    ids = marked.where("kept").orderBy(*newest).limit(most).select("source_stream_id", at, F.lit(True).alias("_in"))
    return marked.join(ids, ["source_stream_id", at], "left").withColumn("kept", F.col("_in").isNotNull()).drop("_in")


def normalise_provider_usage(usage: DataFrame) -> DataFrame:
    """Bring provider usage to one meaning: ``input`` without cache tokens.

    One provider family reports input without cache tokens, the other includes them.
    """
    separate = F.col("provider") == "anthropic"
    cached = F.coalesce(F.col("cache_read_reported"), F.lit(0))
    return usage.select(
        "*",
        F.when(separate, F.col("input_reported"))
        .otherwise(F.col("input_reported") - cached).alias("input"),
        F.col("output_reported").alias("output"),
        cached.alias("cache_read"),
        F.when(separate, F.coalesce(F.col("cache_write_reported"), F.lit(0)))
        .otherwise(F.lit(0)).alias("cache_write"),
    )


def _count(tokens: Column) -> Column:
    """Token counts as a narrow decimal, so that prices keep all their digits."""
    return tokens.cast("decimal(12,0)")


def _per_million(amount: Column) -> Column:
    return amount * F.lit("0.000001").cast("decimal(7,6)")


def cost_usd() -> Column:
    """Cost of normalised usage against catalog prices per million tokens."""
    p_in = F.col("price_in")
    zero = F.lit(0).cast("decimal(5,3)")
    return _per_million(
        _count(F.col("input")) * p_in
        + _count(F.col("cache_read")) * p_in * F.coalesce("cache_read_multiplier", zero)
        + _count(F.col("cache_write")) * p_in * F.coalesce("cache_write_multiplier", zero)
        + _count(F.col("output")) * F.col("price_out")
    )


def token_cost(tokens_in: Column, tokens_out: Column) -> Column:
    """Cost of plain token counts at the row's catalog prices."""
    return _per_million(
        _count(tokens_in) * F.col("price_in") + _count(tokens_out) * F.col("price_out")
    )


def estimate_before_call(tokens_in: Column, max_tokens: Column) -> Column:
    """Worst-case cost of a request before it is sent."""
    return token_cost(tokens_in, max_tokens)


def check_cost(usage: DataFrame, catalog: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Compare each metered cost with tokens times rates.

    ``outcome`` is within, outside or, for a model the catalog lacks, unpriced.
    """
    priced = usage.join(
        catalog.select(F.col("id").alias("model"), "price_in", "price_out"), "model", "left"
    )
    expected = token_cost(F.col("tokens_in"), F.col("tokens_out"))
    return priced.withColumn("expected_usd", expected.cast("decimal(18,8)")).withColumn(
        "within", F.abs(F.col("cost_usd") - F.col("expected_usd"))
        <= F.lit(str(tolerance)).cast("decimal(6,4)") * F.col("expected_usd"),
    ).withColumn(
        "outcome", F.when(F.col("price_in").isNull() | F.col("price_out").isNull(), "unpriced")
        .when(F.col("within"), "within").otherwise("outside"),
    )
