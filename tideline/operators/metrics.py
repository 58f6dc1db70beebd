"""Metrics, composite scores and rollups; every function works for all users at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clamp, r6, rate0, saturate, seconds_between
from .vocabulary import TERMINAL


def _is(status: str) -> Column:
    return F.col("status") == status


def resolved() -> Column:
    return F.col("status").isin(TERMINAL)


def forgetting_rate() -> Column:
    return rate0(F.count_if(_is("forgotten")), F.count_if(resolved()))


def completion_rate() -> Column:
    return rate0(F.count_if(_is("completed")), F.count_if(resolved()))


def task_metrics(tasks: DataFrame, *keys: str) -> DataFrame:
    """Counts, rates, mean minutes of work and of delay against the deadline, by any keys."""
    minutes = F.avg(F.when(_is("completed"), seconds_between("completed_at", "started_at") / 60))
    delay = F.avg(F.when(_is("completed"), seconds_between("completed_at", "deadline_at") / 60))
    return tasks.groupBy(*keys).agg(F.count("*").alias("tasks"), r6(completion_rate()).alias("completion_rate"), r6(forgetting_rate()).alias("forgetting_rate"), r6(minutes).alias("avg_minutes"), r6(delay).alias("avg_delay_minutes"))


def interruption_metrics(rows: DataFrame, *keys: str) -> DataFrame:
    s = F.coalesce("duration_seconds", F.lit(0))
    return rows.groupBy(*keys).agg(F.count("*").alias("interruptions"), r6(F.sum(s) / 60).alias("total_minutes"), r6(F.avg(s) / 60).alias("avg_minutes"))


def session_metrics(sessions: DataFrame, *keys: str) -> DataFrame:
    delay = F.col("resume_delay_seconds")
    return sessions.groupBy(*keys).agg(F.count("*").alias("sessions"), r6(F.avg("focused_time_seconds") / 60).alias("avg_focus_minutes"), F.sum("context_switch_count").alias("switches"), F.count(delay).alias("resumes"), r6(F.avg(delay)).alias("avg_resume_delay"), F.sum("focused_time_seconds").alias("focused"), F.sum("interruption_time_seconds").alias("interrupted"))


def focus_metrics(sessions: DataFrame, events: DataFrame, *keys: str) -> DataFrame:
    """Session metrics with the number of pauses; keys without sessions are absent."""
    pauses = events.where("event_type = 'paused'").groupBy(*keys).agg(F.count("*").alias("pauses"))
    return session_metrics(sessions, *keys).join(pauses, list(keys), "left").na.fill(0, ["pauses"])


def switches_by_category(sessions: DataFrame, tasks: DataFrame, category: str = "category") -> DataFrame:
    d = sessions.join(tasks.select("task_id", category), "task_id", "left").where(F.col(category).isNotNull())
    return d.groupBy(category).agg(F.sum("context_switch_count").alias("switches"))


def heatmap(tasks: DataFrame, least: int = 3) -> DataFrame:
    """User and category by six 4-hour buckets: completed of all and forgotten of resolved tasks; null for less than
    ``least``."""
    d = tasks.withColumn("bucket", F.floor(F.hour("created_at") / 4).cast("int"))
    n = F.count(F.lit(1))
    done = F.when(n >= least, r6(F.count_if(_is("completed")) / n))
    lost = F.when(n >= least, r6(forgetting_rate()))
    return d.groupBy("user_id", "category").pivot("bucket", list(range(6))).agg(n.alias("n"), done.alias("done"), lost.alias("lost"))


def base_by_user(tasks: DataFrame, interruptions: DataFrame, sessions: DataFrame) -> DataFrame:
    """One wide row per user of what the composite scores need."""
    t = tasks.groupBy("user_id").agg(forgetting_rate().alias("forget"), F.count("*").alias("tasks"))
    i = interruptions.groupBy("user_id").agg(F.count("*").alias("interruptions"), F.sum(F.coalesce("duration_seconds", F.lit(0))).alias("interruption_s"))
    s = sessions.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("context_switch_count").alias("switches"), F.avg("resume_delay_seconds").alias("delay"), F.sum(F.col("focused_time_seconds") + F.col("interruption_time_seconds")).alias("active_s"))
    d = t.join(i, "user_id", "left").join(s, "user_id", "left")
    return d.na.fill(0, ["interruptions", "interruption_s", "sessions", "switches", "active_s"])


def friction(base: DataFrame, hourly: float = 6, per_session: float = 3, minutes: float = 30, forget_scale: float = 100) -> DataFrame:
    """0.35 forgetting + 0.25 interruptions per active hour + 0.2 switches per session + 0.2 resume delay, each 0-100."""
    per_hour = F.when(F.col("active_s") > 0, F.col("interruptions") / (F.col("active_s") / 3600)).otherwise(0.0)
    per_s = F.when(F.col("sessions") > 0, F.col("switches") / F.col("sessions")).otherwise(0.0)
    parts = {"forgetting": clamp(F.col("forget") * forget_scale, 0.0, 100.0), "interruption": saturate(per_hour, hourly), "switching": saturate(per_s, per_session), "recovery": saturate(F.coalesce(F.col("delay") / 60, F.lit(0.0)), minutes)}
    score = 0.35 * parts["forgetting"] + 0.25 * parts["interruption"] + 0.2 * parts["switching"] + 0.2 * parts["recovery"]
    keys = [c for c in ("user_id", "period_start") if c in base.columns]
    return base.select(*keys, *[r6(v).alias(k) for k, v in parts.items()], r6(clamp(score, 0.0, 100.0)).alias("friction"))


def friction_v2(base: DataFrame) -> DataFrame:
    """The later scales: forgetting times 200, 8 an hour, 4 a session, 45 minutes."""
    return friction(base, 8, 4, 45, 200)


def forget_risk(base: DataFrame, tasks: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """0.4 recent forgetting + 0.3 interruption density + 0.2 switching + 0.1 share of open tasks near their deadline."""
    now = F.lit(as_of).cast("timestamp")
    recent = F.col("created_at") >= now - F.make_dt_interval(F.lit(days))
    lost = rate0(F.count_if(recent & _is("forgotten")), F.count_if(recent & resolved()))
    near = rate0(F.count_if(~resolved() & (F.col("deadline_at") <= now + F.make_dt_interval(F.lit(1)))), F.count_if(~resolved()))
    d = base.join(tasks.groupBy("user_id").agg(lost.alias("recent"), near.alias("near")), "user_id")
    per_hour = F.when(F.col("active_s") > 0, F.col("interruptions") / (F.col("active_s") / 3600)).otherwise(0.0)
    per_s = F.when(F.col("sessions") > 0, F.col("switches") / F.col("sessions")).otherwise(0.0)
    one = F.lit(1.0)
    score = 0.4 * F.least(one, F.col("recent") * 2) + 0.3 * F.least(one, per_hour / 6) + 0.2 * F.least(one, per_s / 3) + 0.1 * F.col("near")
    return d.select("user_id", r6(F.least(one, score)).alias("forget_risk"))


def windowed_rates(sessions: DataFrame, interruptions: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    """Switches and interruptions per active hour in the last hours, and mean resume delay in the last 7 days."""
    now = F.lit(as_of).cast("timestamp")
    since = now - F.make_dt_interval(F.lit(0), F.lit(hours))
    active = F.sum(F.when(F.col("session_start") >= since, F.col("focused_time_seconds") + F.col("interruption_time_seconds"))) / 3600
    week = F.col("session_start") >= now - F.make_dt_interval(F.lit(7))
    s = sessions.groupBy("user_id").agg(active.alias("h"), F.sum(F.when(F.col("session_start") >= since, F.col("context_switch_count"))).alias("sw"), F.avg(F.when(week, F.col("resume_delay_seconds"))).alias("recovery_s"), F.count(F.when(week, F.col("resume_delay_seconds"))).alias("recovery_n"))
    i = interruptions.where(F.col("start_time") >= since).groupBy("user_id").agg(F.count("*").alias("n"))
    d = s.join(i, "user_id", "left")
    per = lambda x: r6(F.when(F.col("h") > 0, F.coalesce(x, F.lit(0)) / F.col("h")).otherwise(0.0))
    return d.select("user_id", per("sw").alias("switch_rate"), per("n").alias("interruption_rate"), r6(F.col("recovery_s")).alias("recovery_s"), "recovery_n")


def _recent(tasks: DataFrame, as_of: str, days: int) -> DataFrame:
    return tasks.where(F.col("created_at") >= F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days)))


def reliability(tasks: DataFrame, as_of: str, days: int = 30, by: str = "completed_at") -> DataFrame:
    """1 - variation of the daily completed share of the last days' tasks; 0.5 with less than two days.

    Days are those of completion, so the share is 1 on each; ``by`` created_at gives one that varies."""
    d = _recent(tasks, as_of, days).where(F.col(by).isNotNull()).groupBy("user_id", F.to_date(by).alias("day")).agg((F.count_if(_is("completed")) / F.count("*")).alias("share"))
    m, s = F.avg("share"), F.stddev_samp("share")
    per = d.groupBy("user_id").agg(F.count("*").alias("sample_days"), r6(F.when(F.count("*") < 2, 0.5).otherwise(F.when(m > 0, clamp(1 - s / m, 0.0, 1.0)).otherwise(0.0))).alias("reliability"))
    return tasks.select("user_id").distinct().join(per, "user_id", "left").select("user_id", F.coalesce("sample_days", F.lit(0)).alias("sample_days"), F.coalesce("reliability", F.lit(0.5)).alias("reliability"))


def consistency(tasks: DataFrame) -> DataFrame:
    """Mean over categories of the share of the commonest location."""
    per = tasks.groupBy("user_id", "category", "location_id").agg(F.count("*").alias("n"))
    top = F.max(F.when(F.col("location_id").isNotNull(), F.col("n")))
    cat = per.groupBy("user_id", "category").agg((F.coalesce(top, F.lit(0)) / F.sum("n")).alias("share"))
    return cat.groupBy("user_id").agg(r6(F.avg("share")).alias("consistency"))


def repetition(tasks: DataFrame, as_of: str, days: int = 30, least_days: int = 14) -> DataFrame:
    """Lag-7 autocorrelation of the gap-filled daily counts of each user's categories in the last days; 0 at least, and
    with too few active days."""
    keys = ["user_id", "category"]
    day = _recent(tasks, as_of, days).groupBy(*keys, F.to_date("created_at").alias("day")).agg(F.count("*").alias("n"))
    spine = day.groupBy(*keys).agg(F.min("day").alias("a"), F.max("day").alias("b"), F.count("*").alias("days")).select(*keys, "days", F.explode(F.sequence("a", "b")).alias("day"))
    full = spine.join(day, [*keys, "day"], "left").na.fill(0, ["n"])
    d = full.withColumn("back", F.lag("n", 7).over(Window.partitionBy(*keys).orderBy("day")))
    c = F.corr(F.col("n").cast("double"), F.col("back").cast("double"))
    value = F.when(F.col("days") >= least_days, F.greatest(F.lit(0.0), F.coalesce(F.nanvl("c", F.lit(0.0)), F.lit(0.0)))).otherwise(0.0)
    return d.groupBy(*keys).agg(F.max("days").alias("days"), c.alias("c")).select(*keys, r6(value).alias("repetition"))


def repetition_strength(found: DataFrame) -> DataFrame:
    """The mean of a user's categories."""
    return found.groupBy("user_id").agg(F.count("*").alias("categories"), r6(F.avg("repetition")).alias("repetition_strength"))


def time_lost(base: DataFrame) -> DataFrame:
    return base.select("user_id", r6(F.col("interruption_s") / 3600).alias("interruption_hours"), r6(F.col("interruption_s") / 3600 + F.col("switches") * 5 / 60).alias("hours_lost"))


def daily_friction(tasks: DataFrame, interruptions: DataFrame, sessions: DataFrame) -> DataFrame:
    """The parts of friction and its score for every user and creation day, with that day's counts and rates."""
    keys = ["user_id", "period_start"]
    day = lambda c: F.to_date(c).alias("period_start")
    t = tasks.groupBy("user_id", day("created_at")).agg(F.count("*").alias("tasks"), completion_rate().alias("done"), forgetting_rate().alias("forget"))
    i = interruptions.groupBy("user_id", day("start_time")).agg(F.count("*").alias("interruptions"))
    active = F.sum(F.col("focused_time_seconds") + F.col("interruption_time_seconds"))
    s = sessions.groupBy("user_id", day("session_start")).agg(F.count("*").alias("sessions"), F.sum("context_switch_count").alias("switches"), F.avg("resume_delay_seconds").alias("delay"), active.alias("active_s"))
    base = t.join(i, keys, "left").join(s, keys, "left").na.fill(0, ["interruptions", "sessions", "switches", "active_s"])
    return base.select(*keys, "tasks", "done", F.col("forget").alias("lost"), "interruptions").join(friction(base), keys)


def daily_rollup(tasks: DataFrame, interruptions: DataFrame, sessions: DataFrame) -> DataFrame:
    """Per user and creation day: count, rates in percent, interruptions and friction of that day, as long rows."""
    d = daily_friction(tasks, interruptions, sessions).select("user_id", "period_start", F.col("tasks").cast("double").alias("n"), (F.col("done") * 100).alias("done"), (F.col("lost") * 100).alias("lost"), F.col("interruptions").cast("double").alias("i"), F.col("friction").alias("f"))
    return d.select("user_id", "period_start", F.expr("stack(5, 'task_count', n, 'completion_rate', done, 'forgetting_rate', lost, 'interruption_count', i, 'friction_score', f) AS (metric_name, value)")).withColumn("value", r6(F.col("value")))


def breakdown(rows: DataFrame, key: Column, value: Column, name: str) -> DataFrame:
    """(user_id, name): a map from each key, as text, to an aggregate of the user's rows; null keys are left out."""
    per = rows.where(key.isNotNull()).groupBy("user_id", key.cast("string").alias("_k")).agg(value.alias("_v"))
    return per.groupBy("user_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_k", "_v")))).alias(name))


def overview(tasks: DataFrame, interruptions: DataFrame, sessions: DataFrame, events: DataFrame, since: str, days: int) -> DataFrame:
    """One wide row a user of the last ``days``: totals and means of tasks, interruptions and sessions, and their
    breakdowns as maps. Users without tasks in the period are absent."""
    now = F.lit(since).cast("timestamp")
    t, i, s, e = (d.where(F.col(c) >= now) for d, c in ((tasks, "created_at"), (interruptions, "start_time"), (sessions, "session_start"), (events, "event_time")))
    n, switches = F.count("*"), F.sum("context_switch_count")
    parts = [
        task_metrics(t, "user_id").withColumn("tasks_per_day", r6(F.col("tasks") / days)),
        interruption_metrics(i, "user_id").withColumnsRenamed({"total_minutes": "interruption_minutes", "avg_minutes": "avg_interruption_minutes"}),
        focus_metrics(s, e, "user_id"),
        *[breakdown(t, F.col(k), n, f"tasks_by_{k}") for k in ("category", "location_id")],
        *[breakdown(t, k, r6(forgetting_rate()), f"forgetting_by_{name}") for name, k in (("weekday", F.weekday("created_at")), ("hour", F.hour("created_at")), ("category", F.col("category")), ("location_id", F.col("location_id")))],
        *[breakdown(i, k, n, f"interruptions_by_{name}") for name, k in (("weekday", F.weekday("start_time")), ("hour", F.hour("start_time")), ("type", F.col("interruption_type")))],
        breakdown(s.join(tasks.select("task_id", "category"), "task_id"), F.col("category"), switches, "switches_by_category"),
        breakdown(s, F.col("location_id"), switches, "switches_by_location_id"),
    ]
    d = reduce(lambda a, b: a.join(b, "user_id", "left"), parts)
    return d.na.fill(0, ["interruptions", "sessions", "switches", "resumes", "pauses"])


def metric_series(tasks: DataFrame, sessions: DataFrame, daily: DataFrame) -> DataFrame:
    """(user_id, metric, day, value): minutes of completed tasks and of sessions, and the daily forgetting rate and
    friction; what distributions and trends of a user's metrics are made of."""
    none = F.lit(None).cast("date").alias("day")
    took = seconds_between("completed_at", "started_at") / 60
    parts = [
        tasks.where(_is("completed") & took.isNotNull()).select("user_id", F.lit("task_duration").alias("metric"), none, r6(took).alias("value")),
        sessions.select("user_id", F.lit("session_duration").alias("metric"), none, r6((F.col("focused_time_seconds") + F.col("interruption_time_seconds")) / 60).alias("value")),
        daily.where("metric_name IN ('forgetting_rate', 'friction_score')").select("user_id", F.concat(F.lit("daily_"), "metric_name").alias("metric"), F.col("period_start").alias("day"), "value"),
    ]
    return reduce(DataFrame.unionByName, parts)


def metric_endpoints(series: DataFrame, least: int = 5) -> DataFrame:
    """Size, mean and bounds of each series and, for daily ones of at least so many days, the slope by position; shorter
    ones are marked as insufficient instead of being filled with invented values."""
    d = series.withColumn("_i", F.when(F.col("day").isNotNull(), F.row_number().over(Window.partitionBy("user_id", "metric").orderBy("day")) - 1).cast("double"))
    daily = F.count("day") > 0
    g = d.groupBy("user_id", "metric").agg(F.count("*").alias("n"), r6(F.avg("value")).alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"), (daily & (F.count("*") < least)).alias("insufficient"), F.when(daily & (F.count("*") >= least), F.round(F.regr_slope("value", "_i"), 8)).alias("slope"))
    return g


def dimension_rollup(tasks: DataFrame) -> DataFrame:
    """Category and location rollups in one pass of grouping sets, as long rows keyed by dimension."""
    g = tasks.groupingSets([["user_id", "category"], ["user_id", "location_id"]], "user_id", "category", "location_id")
    d = g.agg(F.count("*").cast("double").alias("n"), (completion_rate() * 100).alias("done"), (forgetting_rate() * 100).alias("lost"), F.grouping("category").alias("g"))
    dim = F.when(F.col("g") == 0, F.concat(F.lit("category:"), "category")).otherwise(F.concat(F.lit("location:"), F.coalesce(F.col("location_id").cast("string"), F.lit("unknown"))))
    return d.select("user_id", dim.alias("dimension"), F.expr("stack(3, 'task_count', n, 'completion_rate', done, 'forgetting_rate', lost) AS (metric_name, value)")).withColumn("value", r6(F.col("value")))


def series_summary(series: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Count, mean, bounds and least-squares slope against the position in the series."""
    d = series.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1)
    return d.groupBy(*keys).agg(F.count("*").alias("n"), r6(F.avg(value)).alias("mean"), r6(F.min(value)).alias("low"), r6(F.max(value)).alias("high"), F.round(F.regr_slope(F.col(value), F.col("_i").cast("double")), 8).alias("slope"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Old and new rows, the last written of each key."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order), F.desc("_new")))
    both = reduce(DataFrame.unionByName, [old.withColumn("_new", F.lit(0)), new.withColumn("_new", F.lit(1))])
    return both.withColumn("_n", n).where("_n = 1").drop("_n", "_new")
