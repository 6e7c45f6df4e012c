"""Checks over agent run logs, approvals and the prompt registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.crypto import sha256
from ..frames import skew

# Allowed state changes of an agent run; None is the start.
TRANSITIONS = (
    (None, "PENDING"), ("PENDING", "PLANNING"), ("PLANNING", "CALLING_TOOL"), ("PLANNING", "DONE"),
    ("CALLING_TOOL", "PLANNING"), ("CALLING_TOOL", "WAITING_APPROVAL"),
    ("WAITING_APPROVAL", "CALLING_TOOL"), ("WAITING_APPROVAL", "PLANNING"),
    ("WAITING_APPROVAL", "CANCELLED"), ("PLANNING", "FAILED"), ("CALLING_TOOL", "FAILED"),
)
# Limits of a run.
MAX_STEPS, MAX_COST_USD, SAME_CALL_REPEAT, APPROVAL_HOURS = 12, 0.20, 3, 24

STEPS_PER_SLICE = 1000


def illegal_transitions(spark: SparkSession, steps: DataFrame) -> DataFrame:
    """State changes that are not allowed. ``steps`` holds run_id, step, state.

    Step numbers may have gaps: a change is judged against the last earlier step that was logged. Long
    runs are cut into slices of steps, so they are no hot spot.
    """
    ordered = skew.before(
        steps.select("run_id", "step", "state"), ["run_id"], ["step", "state"], ["state"], F.floor(F.col("step") / STEPS_PER_SLICE)
    )
    changes = ordered.select(
        "run_id", "step", F.when(F.col("before").isNull(), "START").otherwise(F.col("before.state")).alias("from_state"),
        F.col("state").alias("to_state"),
    )
    allowed = spark.createDataFrame(
        [(a or "START", b) for a, b in TRANSITIONS], "from_state string, to_state string"
    )
    return changes.join(F.broadcast(allowed), ["from_state", "to_state"], "left_anti")


def loop_stops(steps: DataFrame, repeat: int = SAME_CALL_REPEAT) -> DataFrame:
    """Step at which each run is stopped for calling one tool with the same arguments too often."""
    calls = steps.select("run_id", "step", "tool", sha256(F.col("arguments")).alias("_args"))
    numbered = skew.running(
        calls, ["run_id", "tool", "_args"], ["step"], rank="_n", slice=F.floor(F.col("step") / STEPS_PER_SLICE)
    )
    return numbered.filter(F.col("_n") == repeat).groupBy("run_id").agg(
        F.min("step").alias("stop_step"), F.min_by("tool", "step").alias("tool")
    )


def limit_stops(
    steps: DataFrame, max_steps: int = MAX_STEPS, max_cost_usd: float = MAX_COST_USD
) -> DataFrame:
    """First step of each run beyond its number of steps or its cost."""
    spent = skew.running(
        steps, ["run_id"], ["step"], sums={"spent_usd": F.col("cost_usd")},
        slice=F.floor(F.col("step") / STEPS_PER_SLICE),
    )
    over_steps = F.col("step") > max_steps
    over_cost = F.col("spent_usd") > F.lit(str(max_cost_usd)).cast("decimal(12,6)")
    return (
        spent.filter(over_steps | over_cost)
        .groupBy("run_id")
        .agg(F.min("step").alias("stop_step"),
             F.min_by(F.when(over_cost, "max_cost").otherwise("max_steps"), "step").alias("reason"))
    )


def needs_approval(risk: Column, overwrites: Column) -> Column:
    """Outside actions always, writes only when they replace something, reads never."""
    return (risk == "external") | ((risk == "write") & F.coalesce(overwrites, F.lit(False)))


def approval_status(
    requests: DataFrame, tools: DataFrame, now: Column, hours: int = APPROVAL_HOURS
) -> DataFrame:
    """Status of each tool request: not needed, decided, waiting or expired, and unregistered for a
    tool the register lacks, which nobody can approve."""
    joined = requests.join(tools.select(F.col("id").alias("tool"), "risk_level"), "tool", "left")
    old = F.unix_micros(now) - F.unix_micros("requested_at") > hours * 3_600_000_000
    status = (
        F.when(F.col("risk_level").isNull(), "unregistered")
        .when(~needs_approval(F.col("risk_level"), F.col("overwrites")), "not_needed")
        .when(F.col("decision").isNotNull(), F.col("decision"))
        .when(old, "expired")
        .otherwise("waiting")
    )
    return joined.select(*[F.col(c) for c in requests.columns], status.alias("status"))


def labelled_prompts(prompts: DataFrame, label: str = "production") -> DataFrame:
    """The version of each prompt that holds a label now; the newest if several do."""
    return prompts.filter(F.array_contains("labels", label)).groupBy("tenant_id", "name").agg(
        F.max("version").alias("version"), F.max_by("template", "version").alias("template")
    )
