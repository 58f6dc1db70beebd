"""Derived columns of events, tasks and interruptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import hours_between, seconds_between
from .vocabulary import LATE_HOUR


def calendar(ts: str) -> dict[str, Column]:
    return {"hour": F.hour(ts), "weekday_name": F.date_format(ts, "EEEE"), "weekday": F.weekday(ts), "is_late_night": F.hour(ts) >= LATE_HOUR}


def enrich_events(events: DataFrame) -> DataFrame:
    """Calendar, seconds since the task's previous event, and the number of its earlier starts and resumptions."""
    w = Window.partitionBy("task_id").orderBy("event_time", "id")
    opened = F.sum(F.col("event_type").isin("started", "resumed").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return events.withColumns(calendar("event_time") | {"inter_event_gap_s": seconds_between("event_time", F.lag("event_time").over(w)), "session_index": F.coalesce(opened, F.lit(0)).cast("long")})


def enrich_tasks(tasks: DataFrame, locations: DataFrame) -> DataFrame:
    """Ages in hours, late start, category@location and whether the user was there before."""
    types = locations.select(F.col("id").alias("location_id"), "location_type")  # grows with users: Spark picks the join by its size
    d = tasks.join(types, "location_id", "left").withColumn("task_location_pair", F.concat_ws("@", "category", F.coalesce("location_type", F.lit("UNKNOWN"))))
    w = Window.partitionBy("user_id", "task_location_pair").orderBy("created_at", "task_id")
    return d.withColumns({
        "start_delay_h": F.round(hours_between("started_at", "created_at"), 3),
        "duration_h": F.round(hours_between("completed_at", "started_at"), 3),
        "deadline_h": F.round(hours_between("deadline_at", "created_at"), 3),
        "is_late_night_start": F.coalesce(F.hour("started_at") >= LATE_HOUR, F.lit(False)),
        "is_repeated_context": F.row_number().over(w) > 1,
    })


def enrich_interruptions(rows: DataFrame) -> DataFrame:
    minutes = F.nullif(F.col("duration_seconds"), F.lit(0)) / 60.0
    return rows.withColumns({"hour": F.hour("start_time"), "weekday": F.weekday("start_time"), "density": F.round(1 / minutes, 4)})


def event_features(events: DataFrame) -> DataFrame:
    """Per task: first creation and start, hour, late night, weekend, number of events and of pauses and resumptions."""
    first = lambda kind: F.min(F.when(F.col("event_type") == kind, F.col("event_time")))
    d = events.groupBy("task_id").agg(first("created").alias("created_at"), first("started").alias("started_at"), F.count("*").alias("event_count"), F.count_if(F.col("event_type").isin("paused", "resumed")).alias("switch_count"))
    at = F.coalesce("created_at", "started_at")
    return d.withColumns({"hour": F.hour(at), "is_late": (F.hour(at) >= 21) | (F.hour(at) <= 4), "is_weekend": F.weekday(at) >= 5})


def nearby_interruptions(tasks: DataFrame, rows: DataFrame, minutes: int = 30) -> DataFrame:
    """Interruptions of the same user within so many minutes after a task's creation, ends included.

    Union and one range window by user instead of a range join, so no user's rows are multiplied."""
    t = tasks.select("user_id", "task_id", F.unix_micros("created_at").alias("t"), F.lit(0).alias("is_interruption"))
    i = rows.select("user_id", F.lit(None).cast("long").alias("task_id"), F.unix_micros("start_time").alias("t"), F.lit(1).alias("is_interruption"))
    w = Window.partitionBy("user_id").orderBy("t").rangeBetween(0, minutes * 60_000_000)
    d = t.unionByName(i).withColumn("n_nearby", F.sum("is_interruption").over(w))
    return d.where("is_interruption = 0").select("user_id", "task_id", "n_nearby")
