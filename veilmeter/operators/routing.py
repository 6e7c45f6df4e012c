"""Header merge, trusted labels, model choice and access filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import LABEL_HEADER, LOCAL_ONLY_LABELS
from ..functions.crypto import sha256
from ..functions.text import strip



def merge_headers(*places: Column) -> Column:
    """Merge header maps of one request: names in lower case, a later place wins.

    Inside one map a later entry wins too. Missing places are NULL.
    """
    entries = F.flatten(
        F.array(*[F.coalesce(F.map_entries(p), F.map_entries(F.create_map(F.lit(""), F.lit(""))))
                  for p in places])
    )
    lowered = F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"]))
    last_first = F.reverse(F.filter(lowered, lambda e: e["key"] != ""))
    names = F.array_distinct(F.transform(last_first, lambda e: e["key"]))

    def newest(name: Column) -> Column:
        return F.get(F.filter(last_first, lambda e: e["key"] == name), F.lit(0))["value"]

    return F.map_from_arrays(names, F.transform(names, newest))


def trusted_label(headers: Column, key_metadata: Column, prefix: str = "",
                  header: str = LABEL_HEADER) -> Column:
    """Label of the context, believed only for service keys.

    The flag must be JSON ``true``; the text "true" is not enough.
    """
    flag = F.try_variant_get(F.try_parse_json(key_metadata), f"$.{prefix}service", "variant")
    is_service = (F.schema_of_variant(flag) == "BOOLEAN") & F.variant_get(flag, "$", "boolean")
    label = F.nullif(F.try_element_at(headers, F.lit(header)), F.lit(""))
    return F.when(F.coalesce(is_service, F.lit(False)), F.lower(strip(label)))


def route_by_label(
    requests: DataFrame, catalog: DataFrame, default_local: str, label: str = "label"
) -> DataFrame:
    """Sensitive context goes to a local model and loses its fallbacks."""
    local = catalog.filter("residency = 'local'").select(
        F.col("id").alias("model"), F.lit(True).alias("_local")
    )
    sensitive = F.coalesce(F.col(label).isin(*LOCAL_ONLY_LABELS), F.lit(False))
    joined = requests.join(local, "model", "left")
    kept = F.coalesce("_local", F.lit(False)) | ~sensitive
    return joined.select(
        *[F.col(c) for c in requests.columns],
        F.when(kept, F.col("model")).otherwise(F.lit(default_local)).alias("routed_model"),
        sensitive.alias("disable_fallbacks"),
        F.when(sensitive, F.concat(F.lit("label="), F.col(label))).alias("routing_reason"),
    )


def refused_models(requests: DataFrame, allowed: DataFrame) -> DataFrame:
    """Requests whose model is not on their tenant's allow list (one row per tenant and model)."""
    return requests.join(allowed, ["tenant_id", "model"], "left_anti")


def with_fallback(
    requests: DataFrame, chains: DataFrame, down: DataFrame, at: list[str]
) -> DataFrame:
    """First healthy model of ``model`` and its fallback chain, NULL when none is left.

    ``chains`` holds (model, fallbacks array); ``down`` holds the models that are out, one row per
    ``at`` and model. Requests that disable fallbacks only try their own model.
    """
    out = down.groupBy(*at).agg(F.collect_set("model").alias("_down"))
    joined = requests.join(chains, "model", "left").join(out, at, "left")
    own = F.array("model")
    options = F.when(F.col("disable_fallbacks"), own).otherwise(
        F.concat(own, F.coalesce("fallbacks", F.array().cast("array<string>")))
    )
    none = F.array().cast("array<string>")
    alive = F.filter(options, lambda m: ~F.array_contains(F.coalesce("_down", none), m))
    served = F.get(alive, F.lit(0))
    return joined.select(
        *[F.col(c) for c in requests.columns],
        served.alias("served_model"),
        (served != F.col("model")).alias("fell_back"),
    )


def choose_model(
    requests: DataFrame,
    routes: DataFrame,
    allowed: DataFrame,
    catalog: DataFrame,
    open_breakers: DataFrame,
    spent: DataFrame,
) -> DataFrame:
    """Pick the model of each request from its tenant's routing policy.

    Residency filters the allow list, the first matching route gives the order, providers with an
    open breaker drop out, and a tenant over budget that downgrades keeps its lowest tier only.
    """
    tiers = F.element_at(
        F.create_map(F.lit("small"), F.lit(0), F.lit("medium"), F.lit(1), F.lit("large"), F.lit(2)),
        F.col("tier"),
    )
    usable = (
        allowed.join(catalog.withColumnRenamed("id", "model"), "model")
        .filter((F.col("data_residency") == "any") | (F.col("residency") == "local"))
        .join(open_breakers.select("provider"), "provider", "left_anti")
        .select("tenant_id", "model", tiers.alias("tier_rank"))
    )
    listed = routes.select(
        "tenant_id", "route_no", "task", "max_input_tokens",
        F.posexplode("use_models").alias("pos", "model"),
    )
    # The options left for each route are few; they travel as one array per route.
    options = listed.join(usable, ["tenant_id", "model"], "left").groupBy(
        "tenant_id", "route_no", "task", "max_input_tokens"
    ).agg(
        F.array_sort(F.collect_list(F.when(F.col("tier_rank").isNotNull(),
                                           F.struct("pos", "model", "tier_rank")))).alias("options")
    )
    plan = options.groupBy("tenant_id").agg(
        F.array_sort(F.collect_list(F.struct("route_no", "task", "max_input_tokens", "options")))
        .alias("plan")
    )
    over = spent.select("tenant_id", (F.col("spent_usd") >= F.col("budget_usd")).alias("_over"),
                        "on_hard_limit")
    joined = requests.join(plan, "tenant_id", "left").join(over, "tenant_id", "left")
    fits = F.filter(
        "plan",
        lambda r: (r["task"].isNull() | (r["task"] == F.col("task")))
        & (r["max_input_tokens"].isNull() | (F.col("input_tokens") < r["max_input_tokens"])),
    )
    choices = F.get(fits, F.lit(0))["options"]
    low = F.array_min(F.transform(choices, lambda o: o["tier_rank"]))
    cheap = F.filter(choices, lambda o: o["tier_rank"] == low)
    downgrade = F.coalesce(F.col("_over") & (F.col("on_hard_limit") == "downgrade"), F.lit(False))
    final = F.when(downgrade, cheap).otherwise(choices)
    return joined.select(
        *[F.col(c) for c in requests.columns],
        F.get(final, F.lit(0))["model"].alias("chosen_model"),
        downgrade.alias("downgraded"),
    )


def tenant_view(df: DataFrame, tenant_id: str | None, column: str = "tenant_id") -> DataFrame:
    """Rows of one tenant; without a tenant nothing is visible."""
    if tenant_id is None:
        return df.filter(F.lit(False))
    return df.filter(F.col(column) == tenant_id)


def readable(df: DataFrame, groups: Column | list[str], acl: str = "acl_groups") -> DataFrame:
    """Rows whose access list shares a group with the reader."""
    wanted = groups if isinstance(groups, Column) else F.array(*[F.lit(g) for g in groups])
    return df.filter(F.arrays_overlap(F.col(acl), wanted))


def check_keys(presented: DataFrame, keys: DataFrame, scope: str) -> DataFrame:
    """Validity of each presented secret at its time ``ts``: the first failing check, or ``ok``."""
    known = keys.select(
        F.col("key_hash").alias("_hash"), "tenant_id", "scopes", "expires_at", "revoked_at"
    )
    joined = presented.withColumn("_hash", sha256(F.col("secret"))).join(known, "_hash", "left")
    verdict = (
        F.when(F.col("scopes").isNull(), "unknown")
        .when(F.col("revoked_at") <= F.col("ts"), "revoked")
        .when(F.col("expires_at") <= F.col("ts"), "expired")
        .when(~F.array_contains("scopes", scope), "scope")
        .otherwise("ok")
    )
    return joined.select(*[F.col(c) for c in presented.columns], "tenant_id", verdict.alias("verdict"))


