"""Work sessions from lifecycle events and from context events, as windows; no per-task loops."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import micros, seconds_between
from .vocabulary import CLOSING, IDLE_MINUTES, OPENING, SWITCH_SECONDS

_UP_TO_BEFORE = (Window.unboundedPreceding, -1)


def latest_status(events: DataFrame) -> DataFrame:
    """Per task: its last state, and when it was first seen, first started and last ended as completed."""
    last = F.max_by("event_type", F.struct("event_time", "id"))
    first = lambda kind: F.min(F.when(F.col("event_type") == kind, F.col("event_time")))
    ended = F.max(F.when(F.col("event_type") == "completed", F.col("event_time")))
    d = events.groupBy("user_id", "task_id").agg(last.alias("status"), F.min("event_time").alias("created_at"), first("started").alias("started_at"), ended.alias("ended_at"))
    return d.withColumn("completed_at", F.when(F.col("status") == "completed", F.col("ended_at"))).drop("ended_at")


def lifecycle_sessions(events: DataFrame, as_of: str, idle_minutes: int = IDLE_MINUTES) -> DataFrame:
    """A session is an opening event that the task's next event closes; a later opening replaces it. A session that
    nothing closes ends after the idle time, at ``as_of`` at the latest. Unknown types open, as created does."""
    kind = F.when(F.col("event_type").isin(CLOSING), F.col("event_type")).otherwise(F.when(F.col("event_type").isin(OPENING), F.col("event_type")).otherwise("created"))
    w = Window.partitionBy("task_id").orderBy("event_time", "id")
    d = events.withColumn("event_type", kind)
    opens = F.col("event_type").isin(OPENING)
    d = d.withColumns({"_next": F.lead("event_type").over(w), "_until": F.lead("event_time").over(w), "_prev": F.lag("event_type").over(w)})
    paused = F.when((F.col("event_type") == "paused") & F.col("_prev").isin(OPENING), F.col("event_time"))
    d = d.withColumn("_paused", F.last(paused, ignorenulls=True).over(w.rowsBetween(*_UP_TO_BEFORE)))
    idle = F.timestamp_micros(F.least(micros("event_time") + idle_minutes * 60_000_000, micros(F.lit(as_of).cast("timestamp"))))
    end = F.coalesce("_until", F.greatest("event_time", idle))
    delay = F.when(F.col("event_type") == "resumed", seconds_between("event_time", "_paused"))
    d = d.where(opens & (F.col("_next").isNull() | F.col("_next").isin(CLOSING)))
    return d.select(F.col("id").alias("session_id"), "user_id", "task_id", "location_id", F.col("event_time").alias("session_start"), end.alias("session_end"), delay.alias("resume_delay_seconds"))


def measured_sessions(sessions: DataFrame, interruptions: DataFrame, untied: str = "none", stretch_s: int = 6 * 3600) -> DataFrame:
    """Add focused and interrupted seconds and counts, from the same task's overlapping interruptions.

    An interruption of 5 minutes in all, clipped or not, is a context switch. Interruptions without a task attach to no
    session, or, with ``untied="same_user"``, to every overlapping one of their user; these meet by stretches of time,
    each pair in the first stretch that both have."""
    stop = F.coalesce("end_time", "start_time")
    i = interruptions.select(F.col("task_id").alias("i_task"), F.col("user_id").alias("i_user"), F.col("start_time").alias("i_start"), stop.alias("i_stop"), F.coalesce("duration_seconds", F.lit(0)).alias("i_s"))
    overlaps = (F.col("i_start") < F.col("session_end")) & (F.col("i_stop") > F.col("session_start"))
    columns = ["session_id", "session_start", "session_end", "i_start", "i_stop", "i_s"]
    met = sessions.join(i, (F.col("task_id") == F.col("i_task")) & overlaps).select(*columns)
    if untied == "same_user":
        at = lambda c: F.floor(F.unix_seconds(c) / stretch_s)
        over = lambda a, b: F.explode(F.sequence(at(a), F.greatest(at(a), at(b))))
        s = sessions.select("session_id", "user_id", "session_start", "session_end", over("session_start", "session_end").alias("stretch"))
        u = i.where("i_task IS NULL").select("i_user", "i_start", "i_stop", "i_s", over("i_start", "i_stop").alias("i_stretch"))
        first = F.col("stretch") == F.greatest(at("session_start"), at("i_start"))
        met = met.unionByName(s.join(u, (F.col("user_id") == F.col("i_user")) & (F.col("stretch") == F.col("i_stretch")) & overlaps).where(first).select(*columns))
    elif untied != "none":
        raise ValueError(f"untied is 'none' or 'same_user', not {untied!r}")
    overlap = F.floor(seconds_between(F.least("i_stop", "session_end"), F.greatest("i_start", "session_start")))
    per = met.groupBy("session_id").agg(F.sum(overlap).alias("interruption_time_seconds"), F.count_if(F.col("i_s") >= SWITCH_SECONDS).alias("context_switch_count"), F.count("*").alias("interruption_count"))
    d = sessions.join(per, "session_id", "left").na.fill(0, ["interruption_time_seconds", "context_switch_count", "interruption_count"])
    total = F.floor(seconds_between("session_end", "session_start"))
    return d.withColumn("focused_time_seconds", F.greatest(F.lit(0), total - F.col("interruption_time_seconds")))


def context_sessions(events: DataFrame) -> DataFrame:
    """Sessions of context events by (user, task): START opens, COMPLETE closes, other events open where none is.

    Time before an INTERRUPTION, PAUSE, TASK_SWITCH, or a COMPLETE without a pending interruption, is focused; a
    RESUME or COMPLETE ends the interruption that was last begun since the last RESUME."""
    w = Window.partitionBy("user_id", "task_id").orderBy("ts", "id")
    kind = F.col("event_type")
    opens = (kind == "START") | F.lag("event_type").over(w).isNull() | (F.lag("event_type").over(w) == "COMPLETE")
    d = events.withColumn("_open", opens.cast("int")).withColumn("seq", F.sum("_open").over(w))
    s = Window.partitionBy("user_id", "task_id", "seq").orderBy("ts", "id")
    d = d.withColumns({"_gap": seconds_between("ts", F.lag("ts").over(s)), "_epoch": F.coalesce(F.sum((kind == "RESUME").cast("int")).over(s.rowsBetween(*_UP_TO_BEFORE)), F.lit(0))})
    e = Window.partitionBy("user_id", "task_id", "seq", "_epoch").orderBy("ts", "id").rowsBetween(*_UP_TO_BEFORE)
    d = d.withColumn("_pending", F.max(F.when(kind == "INTERRUPTION", F.col("ts"))).over(e))
    focused = kind.isin("INTERRUPTION", "PAUSE", "TASK_SWITCH") | ((kind == "COMPLETE") & F.col("_pending").isNull())
    lost = F.when(kind.isin("RESUME", "COMPLETE") & F.col("_pending").isNotNull(), seconds_between("ts", "_pending"))
    d = d.withColumns({"_focus": F.when(focused, F.coalesce("_gap", F.lit(0.0))).otherwise(0.0), "_lost": lost})
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c.isNotNull(), F.struct("ts", "id", c.alias("v"))))), lambda x: x["v"])
    out = d.groupBy("user_id", "task_id", "seq").agg(
        F.min_by("task_category", F.struct("ts", "id")).alias("task_category"),
        F.min_by("context", F.struct("ts", "id")).alias("context"),
        F.min("ts").alias("start_time"),
        F.max("ts").alias("end_time"),
        F.round(F.sum("_focus"), 3).alias("focused_time_seconds"),
        F.round(F.coalesce(F.sum("_lost"), F.lit(0.0)), 3).alias("interruption_time_seconds"),
        F.count_if(kind == "INTERRUPTION").alias("num_interruptions"),
        F.count_if(kind == "TASK_SWITCH").alias("num_context_switches"),
        in_order(F.when(kind == "RESUME", F.col("_lost"))).alias("resume_delays_seconds"),
        in_order(F.col("_lost")).alias("interruption_durations_seconds"),
        F.bool_or(kind == "COMPLETE").alias("completed"),
    )
    return out.withColumn("session_duration_seconds", seconds_between("end_time", "start_time"))


def session_totals(sessions: DataFrame, *scope: str) -> DataFrame:
    """Totals of context sessions by scope; means over all array elements, switches per focused hour."""
    total = lambda c: F.sum(F.aggregate(c, F.lit(0.0), lambda a, x: a + x))
    d = sessions.groupBy(*scope).agg(F.count("*").alias("sessions"), F.sum("focused_time_seconds").alias("focused"), F.sum("interruption_time_seconds").alias("interrupted"), F.sum("num_context_switches").alias("switches"), F.sum("num_interruptions").alias("interruptions"), total("resume_delays_seconds").alias("_d"), F.sum(F.size("resume_delays_seconds")).alias("_n"))
    return d.withColumns({"avg_resume_delay": F.when(F.col("_n") > 0, F.col("_d") / F.col("_n")), "switches_per_hour": F.when(F.col("focused") > 0, F.col("switches") / (F.col("focused") / 3600)), "interruptions_per_session": F.col("interruptions") / F.col("sessions")}).drop("_d", "_n")


def session_features(sessions: DataFrame) -> DataFrame:
    mean = lambda c: F.when(F.size(c) > 0, F.aggregate(c, F.lit(0.0), lambda a, x: a + x) / F.size(c)).otherwise(0.0)
    return sessions.select("user_id", "task_id", "seq", "session_duration_seconds", "focused_time_seconds", mean("resume_delays_seconds").alias("avg_resume_delay"), mean("interruption_durations_seconds").alias("avg_interruption"), "num_interruptions", "num_context_switches", F.hour("start_time").alias("hour"), F.weekday("start_time").alias("weekday"))


def session_report(sessions: DataFrame) -> DataFrame:
    """Context sessions flattened for reading."""
    return sessions.select("user_id", "task_id", "seq", "task_category", "context", F.col("session_duration_seconds").alias("duration_s"), F.col("focused_time_seconds").alias("focused_s"), F.col("interruption_time_seconds").alias("interruption_s"), "num_interruptions", F.col("num_context_switches").alias("num_switches"), "completed")


RECOVERY_WEIGHTS = {"interruption_time_seconds": 0.25, "avg_resume_delay": 0.2, "num_context_switches": 0.25, "num_interruptions": 0.15, "avg_interruption": 0.15}


def recovery_cost(sessions: DataFrame) -> DataFrame:
    """Weighted min-max score of each session within the population; a measure without range scores 0."""
    d = session_features(sessions).join(sessions.select("user_id", "task_id", "seq", "interruption_time_seconds"), ["user_id", "task_id", "seq"])
    bounds = d.agg(*[f(c).alias(f"{n}_{c}") for c in RECOVERY_WEIGHTS for n, f in (("lo", F.min), ("hi", F.max))])
    d = d.join(F.broadcast(bounds))  # one row
    score = F.lit(0.0)
    for c, weight in RECOVERY_WEIGHTS.items():
        span = F.col(f"hi_{c}") - F.col(f"lo_{c}")
        score = score + weight * F.when(span > 1e-9, (F.col(c) - F.col(f"lo_{c}")) / span).otherwise(0.0)
    return d.select("user_id", "task_id", "seq", F.round(score, 6).alias("recovery_cost"))


def visits(events: DataFrame, gap_minutes: int = 60) -> DataFrame:
    """Visits of a user to a context: completed tasks without a longer gap; tasks in order, each once."""
    w = Window.partitionBy("user_id", "context").orderBy("ts", "id")
    gap = seconds_between("ts", F.lag("ts").over(w)) > gap_minutes * 60
    d = events.where("event_type = 'COMPLETE'").withColumn("_new", F.coalesce(gap.cast("int"), F.lit(1))).withColumn("visit", F.sum("_new").over(w))
    tasks = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("ts", "id", "task_id"))), lambda x: x["task_id"]))
    return d.groupBy("user_id", "context", "visit").agg(tasks.alias("tasks"), F.min("ts").alias("visit_start"))


def switch_timeline(events: DataFrame, interruptions: DataFrame, tasks: DataFrame) -> DataFrame:
    """Each user's events in order with their task's category, and whether they fall into any interruption of the user,
    ends included: the interruption's latest end among those that began up to the event, by one window, instead of a
    range join."""
    e = events.select("user_id", "id", "task_id", "event_type", F.unix_micros("event_time").alias("t"), F.lit(None).cast("long").alias("stop"), F.lit(1).alias("is_event"))
    i = interruptions.select("user_id", "id", F.unix_micros("start_time").alias("t"), (F.unix_micros("start_time") + F.coalesce("duration_seconds", F.lit(0)) * 1_000_000).alias("stop"), F.lit(0).alias("is_event"))
    w = Window.partitionBy("user_id").orderBy("t")
    reach = F.max("stop").over(w.rangeBetween(Window.unboundedPreceding, 0))
    d = e.unionByName(i, allowMissingColumns=True).withColumn("_stop", reach).where("is_event = 1")
    d = d.withColumn("position", F.row_number().over(Window.partitionBy("user_id").orderBy("t", "id")))
    d = d.join(tasks.select("user_id", "task_id", "category"), ["user_id", "task_id"], "left")
    return d.select("id", "user_id", "position", "category", "event_type", F.coalesce(F.col("_stop") >= F.col("t"), F.lit(False)).alias("in_interruption"))
