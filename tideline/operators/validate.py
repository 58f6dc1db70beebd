"""Validation: tables of issues (stage, severity, rule, row_key). Nothing is dropped or changed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .vocabulary import EVENT_TYPES, INTERRUPTION_TYPES, TERMINAL


def _issues(df: DataFrame, stage: str, key: str, rules: list[tuple[str, str, Column]]) -> DataFrame:
    """One pass: each row becomes the array of the rules that it breaks."""
    broken = [F.when(cond, F.struct(F.lit(sev).alias("severity"), F.lit(rule).alias("rule"))) for sev, rule, cond in rules]
    found = df.select(F.col(key).alias("row_key"), F.explode(F.array_compact(F.array(*broken))).alias("i"))
    return found.select(F.lit(stage).alias("stage"), "i.severity", "i.rule", F.col("row_key").cast("long").alias("row_key"))


def validate_events(events: DataFrame, as_of: str) -> DataFrame:
    kind = F.lower(F.trim("event_type"))
    again = F.row_number().over(Window.partitionBy("user_id", "task_id", "event_type", "event_time").orderBy("id"))
    before = Window.partitionBy("task_id").orderBy("event_time", "id").rowsBetween(Window.unboundedPreceding, -1)
    ended = F.max(kind.isin(TERMINAL).cast("int")).over(before)
    d = events.withColumns({"_again": again, "_ended": ended})
    required = [("error", f"missing_required_field:{c}", F.col(c).isNull()) for c in ("user_id", "task_id", "event_type", "event_time")]
    return _issues(d, "events", "id", required + [
        ("error", "invalid_event_type", F.col("event_type").isNotNull() & ~kind.isin(EVENT_TYPES)),
        ("warning", "future_timestamp", F.col("event_time") > F.lit(as_of).cast("timestamp")),
        ("error", "prehistoric_timestamp", F.col("event_time") < F.lit("2000-01-01").cast("timestamp")),
        ("warning", "duplicate_event", F.col("_again") > 1),
        ("error", "impossible_sequence", (F.col("_ended") == 1) & kind.isin("created", "started")),
    ])


def timestamp_issues(rows: DataFrame, column: str, stage: str = "events", key: str = "id") -> DataFrame:
    """Values that are there but are no timestamp."""
    return _issues(rows, stage, key, [("error", "invalid_timestamp", F.col(column).isNotNull() & F.try_to_timestamp(F.col(column).cast("string")).isNull())])


def validate_interruptions(rows: DataFrame, as_of: str) -> DataFrame:
    required = [("error", f"missing_required_field:{c}", F.col(c).isNull()) for c in ("user_id", "interruption_type", "start_time")]
    return _issues(rows, "interruptions", "id", required + [
        ("error", "invalid_interruption_type", F.col("interruption_type").isNotNull() & ~F.lower(F.trim("interruption_type")).isin(INTERRUPTION_TYPES)),
        ("error", "end_before_start", F.col("end_time") < F.col("start_time")),
        ("error", "negative_duration", F.col("duration_seconds") < 0),
        ("warning", "future_timestamp", F.col("start_time") > F.lit(as_of).cast("timestamp")),
    ])


def validate_tasks(tasks: DataFrame) -> DataFrame:
    return _issues(tasks, "tasks", "task_id", [
        ("error", "invalid_priority", ~F.col("priority").between(1, 5)),
        ("error", "invalid_status", ~F.lower("status").isin(EVENT_TYPES)),
        ("error", "started_before_created", F.col("started_at") < F.col("created_at")),
        ("error", "completed_before_started", F.col("completed_at") < F.col("started_at")),
    ])


def validate_all(*issues: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, issues)


def summary(issues: DataFrame) -> DataFrame:
    return issues.groupBy("stage", "severity", "rule").agg(F.count("*").alias("issues"))


def verdict(issues: DataFrame) -> DataFrame:
    """Errors and warnings in all, and whether there is no error."""
    count = lambda x: F.count_if(F.col("severity") == x)
    return issues.agg(count("error").alias("errors"), count("warning").alias("warnings"), (count("error") == 0).alias("is_clean"))


def validate_model_input(rows: DataFrame, categories: list[str], locations: list[int]) -> DataFrame:
    """Domains and ranges of model input: category, priority, location, weekday, hour, counts and rates."""
    counts = [("error", f"negative:{c}", F.col(c) < 0) for c in rows.columns if c.startswith("n_")]
    rates = [("error", f"out_of_range:{c}", ~F.col(c).between(0, 1)) for c in rows.columns if c.endswith("_rate")]
    return _issues(rows, "model_input", "task_id", [
        ("error", "category_domain", ~F.col("category").isin(categories)),
        ("error", "priority_domain", ~F.col("priority").between(1, 5)),
        ("error", "location_domain", ~F.col("location_id").isin(locations)),
        ("error", "out_of_range:weekday", ~F.col("weekday").between(0, 6)),
        ("error", "out_of_range:hour", ~F.col("hour").between(0, 23)),
    ] + counts + rates)


def leakage_audit(tasks: DataFrame, stored: str, tolerance: float = 5e-3) -> DataFrame:
    """Users and rows where a stored prior forgetting rate differs from the one of strictly earlier tasks."""
    before = Window.partitionBy("user_id").orderBy(F.unix_micros("created_at")).rangeBetween(Window.unboundedPreceding, -1)
    again = F.avg((F.col("status") == "forgotten").cast("double")).over(before)
    d = tasks.withColumn("_again", again)
    bad = ~F.col("_again").eqNullSafe(F.col(stored)) & (F.abs(F.coalesce("_again", F.lit(-1.0)) - F.coalesce(stored, F.lit(-1.0))) > tolerance)
    return d.agg(F.count("*").alias("checked"), F.count_if(bad).alias("leaks"))
