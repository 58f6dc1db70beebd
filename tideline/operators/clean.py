"""Cleaning: deduplication, normalisation, imputation and anomaly flags."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import seconds_between
from .vocabulary import ANOMALY_HOURS


def keep_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key, by an explicit order."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("_n", n).where("_n = 1").drop("_n")


def to_utc(df: DataFrame, columns: list[str]) -> DataFrame:
    """Timestamps from strings or timestamps; what can't be parsed is null."""
    return df.withColumns({c: F.try_to_timestamp(F.col(c).cast("string")) for c in columns})


def clean_events(events: DataFrame) -> DataFrame:
    """Duplicates go before types are lower-cased, so rows that differ in case only both stay."""
    return keep_first(events, ["user_id", "task_id", "event_type", "event_time"], "id").withColumn("event_type", F.lower(F.trim("event_type")))


def clean_interruptions(rows: DataFrame) -> DataFrame:
    """One row per (user, task, type, start); durations and ends are filled from each other, long ones flagged."""
    d = keep_first(rows, ["user_id", "task_id", "interruption_type", "start_time"], "id").withColumn("interruption_type", F.lower(F.trim("interruption_type")))
    filled = F.coalesce("duration_seconds", F.floor(F.greatest(F.lit(0.0), seconds_between("end_time", "start_time"))))
    d = d.withColumn("duration_seconds", filled.cast("long"))
    end = F.coalesce("end_time", F.timestamp_micros(F.unix_micros("start_time") + F.col("duration_seconds") * 1_000_000))
    return d.withColumns({"end_time": end, "is_anomaly": F.coalesce(F.col("duration_seconds") > ANOMALY_HOURS * 3600, F.lit(False))})


def map_values(c: Column, mapping: dict[str, str]) -> Column:
    """Alias of a lower-cased, trimmed value, or that value."""
    plain = F.lower(F.trim(c))
    return F.coalesce(F.try_element_at(F.create_map(*map(F.lit, chain(*mapping.items()))), plain), plain)


def normalise_category(tasks: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Category by its alias, and whether an alias changed it (lower case and trimming alone don't count)."""
    plain = F.lower(F.trim("category"))
    return tasks.withColumn("category_changed", F.coalesce(plain.isin(list(aliases)), F.lit(False))).withColumn("category", map_values(F.col("category"), aliases))


def clean_tasks(tasks: DataFrame, aliases: dict[str, str]) -> DataFrame:
    d = normalise_category(keep_first(tasks, ["task_id"], "created_at"), aliases)
    took = seconds_between("completed_at", "started_at")
    clamped = F.least(F.greatest("priority", F.lit(1)), F.lit(5))
    return d.withColumns({"status": F.lower(F.trim("status")), "priority_clamped": F.coalesce(F.col("priority") != clamped, F.lit(False)), "is_anomaly": F.coalesce(took > ANOMALY_HOURS * 3600, F.lit(False))}).withColumn("priority", clamped)


def tag_category(text: Column, exact: dict[str, str], parts: list[tuple[str, str]], default: str) -> Column:
    """An exact tag first, then the first part that the text contains, in order, else the default."""
    out = F.lit(default)
    for part, value in reversed(parts):
        out = F.when(F.contains(F.lower(text), F.lit(part)), value).otherwise(out)
    for tag, value in exact.items():
        out = F.when(F.lower(text) == tag, value).otherwise(out)
    return out


def cleaning_report(raw_events: DataFrame, raw_interruptions: DataFrame, raw_tasks: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Counts for each operation and table."""
    t = clean_tasks(raw_tasks, aliases).agg(F.count("*").alias("u"), F.count_if("category_changed").alias("c"), F.count_if("priority_clamped").alias("p"), F.count_if("is_anomaly").alias("a"))
    t = t.crossJoin(raw_tasks.agg(F.count("*").alias("n")))  # one row each
    t = t.select(F.lit("tasks").alias("table_name"), F.expr("stack(4, 'duplicates_removed', n - u, 'categories_normalised', c, 'priorities_clamped', p, 'anomalies_flagged', a) AS (operation, rows)"))
    e = raw_events.agg(F.count("*").alias("n"), F.count_distinct(F.struct("user_id", "task_id", "event_type", "event_time")).alias("u"), F.count_if(F.col("event_type") != F.lower(F.trim("event_type"))).alias("c"))
    i = raw_interruptions.agg(F.count("*").alias("n"), F.count_distinct(F.struct("user_id", "task_id", "interruption_type", "start_time")).alias("u"), F.count_if(F.col("duration_seconds").isNull()).alias("d"), F.count_if(F.col("end_time").isNull()).alias("e"))
    e = e.select(F.lit("events").alias("table_name"), F.expr("stack(2, 'duplicates_removed', n - u, 'types_normalised', c) AS (operation, rows)"))
    i = i.select(F.lit("interruptions").alias("table_name"), F.expr("stack(3, 'duplicates_removed', n - u, 'durations_filled', d, 'ends_filled', e) AS (operation, rows)"))
    return e.unionByName(i).unionByName(t)
