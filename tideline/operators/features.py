"""As-of features: one row per task from strictly earlier history of the same user.

Histories of other tables meet the tasks in one long frame by user and time, so there is one shuffle by user and no
user's tasks are multiplied by their history. Frames end one microsecond before the task; rows of the same instant
don't see each other.

With ``chunk``, a user with more rows than that is split into chunks of about so many: ``in_chunks`` and ``carried`` make
of their history a scan in two levels, so the windows are over (user, chunk) and no user is one task. The result is the
same; the input is read twice or more, so hand in a stored table."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import hours_between, micros, r6, rate
from .vocabulary import LATE_HOUR, TERMINAL

DAY = 86_400_000_000
HOUR = DAY // 24
BEFORE_ALL = -(1 << 62)  # the time of carried rows, outside of every range window


def in_chunks(rows: DataFrame, chunk: int, reach: int = 0) -> DataFrame:
    """Rows (user_id, _t in microseconds, ...) with their ``_chunk``, numbered from 0 by time within the user, ``_end``, the
    user's last one, and ``_halo``.

    Chunks are whole hours and hold about ``chunk`` rows; users with no more than that, and rows without a time, are in
    chunk 0. An hour with more rows stays whole, so rows of an instant are never parted. A row is there once more, as
    halo, in each later chunk that starts within ``reach`` microseconds after it, so range windows see it. Only the counts
    by hour of the users that are split meet the rows in a join by user and hour."""
    hour = F.floor(F.col("_t") / HOUR)
    user, of_user = Window.partitionBy("_user").orderBy("_hour"), Window.partitionBy("_user")
    hours = rows.groupBy(F.col("user_id").alias("_user"), hour.alias("_hour")).agg(F.count("*").alias("_k"))
    before = F.coalesce(F.sum("_k").over(user.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hours = hours.withColumns({"_part": F.floor(before / chunk), "_all": F.sum("_k").over(of_user)}).where(F.col("_all") > chunk)
    hours = hours.withColumn("_chunk", F.dense_rank().over(of_user.orderBy("_part")) - 1)
    hours = hours.withColumns({"_upto": F.max("_chunk").over(user.rangeBetween(0, math.ceil(reach / HOUR))), "_end": F.max("_chunk").over(of_user)})
    met = rows.join(hours, F.col("user_id").eqNullSafe(F.col("_user")) & hour.eqNullSafe(F.col("_hour")), "left")
    first = F.coalesce("_chunk", F.lit(0))
    met = met.withColumns({"_from": first, "_end": F.coalesce("_end", F.lit(0)), "_chunk": F.explode(F.sequence(first, F.coalesce("_upto", F.lit(0))))})
    return met.withColumn("_halo", F.col("_chunk") > F.col("_from")).drop("_user", "_hour", "_k", "_part", "_all", "_upto", "_from")


def carried(chunks: DataFrame, keys: list[str], measures: dict[str, Callable]) -> DataFrame:
    """One row for each chunk and key values that earlier chunks of the user had, with the ``measures`` of all those
    (columns and the function, ``F.sum`` or ``F.max``, that merges them), at a time before all.

    Sums by chunk are taken first, so a window here has one row a chunk; their rows are at most the key values of a user
    times the user's chunks."""
    own = chunks.where("_end > 0 AND NOT _halo")
    d = own.groupBy("user_id", *keys, "_chunk").agg(*[f(c).alias(c) for c, f in measures.items()], F.max("_end").alias("_end"))
    w = Window.partitionBy("user_id", *keys).orderBy("_chunk")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({c: f(c).over(so_far) for c, f in measures.items()} | {"_next": F.coalesce(F.lead("_chunk").over(w), "_end")})
    d = d.where("_next > _chunk").withColumn("_chunk", F.explode(F.sequence(F.col("_chunk") + 1, F.col("_next"))))
    return d.drop("_next", "_end").withColumns({"_t": F.lit(BEFORE_ALL), "_halo": F.lit(False), "_carry": F.lit(True)})


def task_features(tasks: DataFrame, chunk: int | None = None) -> DataFrame:
    """Counts, rates, recency and streak over a user's earlier tasks (features of the user, category, location, weekday,
    hour and category@location). Final statuses of earlier tasks count even where they were reached later; see
    ``resolved_asof_rate``. ``chunk``: see the module."""
    lost, done, res = F.col("status") == "forgotten", F.col("status") == "completed", F.col("status").isin(TERMINAL)
    t = tasks.withColumns({"_t": micros("created_at"), "_w": F.weekday("created_at"), "_h": F.hour("created_at")})
    t = t.withColumns({"_n": F.lit(1).cast("long"), "_lost": lost.cast("long"), "_done": done.cast("long"), "_res": res.cast("long"), "_last": F.col("_t")})
    user = ["user_id"] if chunk is None else ["user_id", "_chunk"]
    counted = Window.partitionBy(*user).orderBy("_t").rangeBetween(Window.unboundedPreceding, 0)
    if chunk is not None:
        t = _split_tasks(in_chunks(t, chunk, DAY), F.coalesce(lost, F.lit(True)), counted)

    def before(*keys: str) -> Window:
        return Window.partitionBy(*user, *keys).orderBy("_t").rangeBetween(Window.unboundedPreceding, -1)

    def n(what: str, w: Window) -> Column:
        return F.coalesce(F.sum(what).over(w), F.lit(0))

    u = before()
    day = Window.partitionBy(*user).orderBy("_t").rangeBetween(-DAY, -1)
    similar = before("category")
    rates = {f"{name}_forgetting_rate": r6(rate(n("_lost", before(key)), n("_res", before(key)))) for name, key in (("category", "category"), ("location", "location_id"), ("weekday", "_w"), ("hour", "_h"))}
    # The streak: earlier tasks since the last one that was not forgotten.
    t = t.withColumns({"_rank": n("_n", u), "_rank_incl": F.sum("_n").over(counted)})
    other = F.when(~lost, F.col("_rank_incl"))
    if chunk is not None:
        other = F.when(F.col("_carry"), F.col("_other")).when(~F.col("_halo"), other)
    out = t.withColumns({
        "previous_forgetting_count": n("_lost", u),
        "previous_completion_count": n("_done", u),
        "completion_rate": r6(rate(n("_done", u), n("_res", u))),
        **rates,
        "task_frequency": n("_n", similar),
        "days_since_similar": r6((F.col("_t") - F.max("_last").over(similar)) / DAY),
        "deadline_distance_hours": r6(hours_between("deadline_at", "created_at")),
        "tasks_today": F.count("*").over(day),
        "repeated_context_count": F.when(F.col("location_id").isNull(), n("_n", similar)).otherwise(n("_n", before("category", "location_id"))),
        "forgetting_streak": F.col("_rank") - F.coalesce(F.max(other).over(u), F.lit(0)),
        "is_late_night": F.col("_h") >= LATE_HOUR,
        "priority": F.coalesce(F.col("priority"), F.lit(3)) if "priority" in tasks.columns else F.lit(3),
        "task_location_pair": F.concat_ws("@", "category", F.coalesce(F.col("location_id").cast("string"), F.lit("UNKNOWN"))),
        "will_forget": lost.cast("int"),
    })
    if chunk is not None:
        out = out.where("NOT _carry AND NOT _halo").drop("_chunk", "_end", "_halo", "_carry", "_other")
    out = out.withColumn("location_forgetting_rate", F.when(F.col("location_id").isNotNull(), F.col("location_forgetting_rate")))
    return out.withColumn("is_repeated_context", F.col("repeated_context_count") > 0).drop("_t", "_w", "_h", "_n", "_lost", "_done", "_res", "_last", "_rank", "_rank_incl")


def _split_tasks(t: DataFrame, lost: Column, counted: Window) -> DataFrame:
    """Tasks in chunks and what earlier chunks hand to them; halo rows count in range windows only."""
    sums = dict.fromkeys(("_n", "_lost", "_done", "_res"), F.sum)
    history = carried(t, ["category", "location_id", "_w", "_h"], sums | {"_last": F.max})
    # Of a chunk, the rank of its last task that was not forgotten; ranks go on from the tasks of earlier chunks.
    own = t.where("_end > 0 AND NOT _halo").withColumn("_other", F.when(~lost, F.count("*").over(counted)))
    ends = own.groupBy("user_id", "_chunk").agg(F.count("*").alias("_k"), F.max("_other").alias("_other"))
    earlier = Window.partitionBy("user_id").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_other", F.coalesce(F.sum("_k").over(earlier), F.lit(0)) + F.col("_other"))
    ends = ends.withColumn("_other", F.max("_other").over(earlier)).where("_chunk > 0").drop("_k")
    ends = ends.withColumns({"_t": F.lit(BEFORE_ALL), "_halo": F.lit(False), "_carry": F.lit(True)})
    rows = t.withColumns({c: F.when(~F.col("_halo"), F.col(c)) for c in (*sums, "_last")} | {"_carry": F.lit(False)})
    return rows.unionByName(history, allowMissingColumns=True).unionByName(ends, allowMissingColumns=True)


def resolved_asof_rate(tasks: DataFrame, chunk: int | None = None) -> DataFrame:
    """Prior forgetting rate without the label-timing leak: a task counts from the moment it was completed, forgotten or
    cancelled, and not at all if that isn't known.

    Tasks appear twice in one frame, as created and as resolved, and only resolutions before a creation count.
    ``chunk``: see the module."""
    when = F.coalesce(*[F.col(c) for c in ("completed_at", "forgotten_at", "cancelled_at") if c in tasks.columns])
    made = tasks.select("user_id", "task_id", micros("created_at").alias("_t"), F.lit(0).alias("lost"), F.lit(0).alias("res"), F.lit(1).alias("made"))
    ended = tasks.where(F.col("status").isin(TERMINAL) & when.isNotNull()).select("user_id", "task_id", micros(when).alias("_t"), (F.col("status") == "forgotten").cast("int").alias("lost"), F.lit(1).alias("res"), F.lit(0).alias("made"))
    d, user = made.unionByName(ended), ["user_id"]
    if chunk is not None:
        d, user = in_chunks(d, chunk), ["user_id", "_chunk"]
        d = d.unionByName(carried(d, [], {"lost": F.sum, "res": F.sum}), allowMissingColumns=True)
    w = Window.partitionBy(*user).orderBy("_t").rangeBetween(Window.unboundedPreceding, -1)
    d = d.withColumns({"l": F.sum("lost").over(w), "r": F.sum("res").over(w)})
    return d.where("made = 1").select("task_id", r6(rate(F.col("l"), F.col("r"))).alias("forgetting_rate_asof"))


def activity_features(points: DataFrame, events: DataFrame, interruptions: DataFrame, sessions: DataFrame, tasks: DataFrame, switch_days: int = 7, chunk: int | None = None) -> DataFrame:
    """Per point (user_id, task_id, created_at): interruptions and their mean length, resumptions, recovery time after
    pauses, sessions of the last week and its friction (0.6 forgetting of resolved tasks + 0.4 interruption load, null
    without such tasks), all strictly before the point. ``chunk``: see the module."""
    long = "user_id", "task_id", "_t", "kind", "x", "y"

    def rows(df: DataFrame, kind: str, t: Column, x=None, y=None, task=None) -> DataFrame:
        d = df.select("user_id", (F.lit(None).cast("long") if task is None else F.col(task).cast("long")).alias("task_id"), t.alias("_t"), F.lit(kind).alias("kind"), (F.lit(None) if x is None else x).cast("double").alias("x"), (F.lit(None) if y is None else y).cast("double").alias("y"))
        return d.select(*long)

    # A pause and its task's next resumption count from the resumption on.
    w = Window.partitionBy("task_id").orderBy("event_time", "id").rowsBetween(1, Window.unboundedFollowing)
    resumed = F.min(F.when(F.col("event_type") == "resumed", F.col("event_time"))).over(w)
    pauses = events.withColumn("_r", resumed).where("event_type = 'paused' AND _r IS NOT NULL")
    parts = [
        rows(points, "point", micros("created_at"), task="task_id"),
        rows(interruptions, "interruption", micros("start_time"), F.col("duration_seconds")),
        rows(events.where("event_type = 'resumed'"), "resumed", micros("event_time")),
        rows(pauses, "recovery", micros("_r"), (micros("_r") - micros("event_time")) / 1e6),
        rows(tasks.where(F.col("status").isin(TERMINAL)), "task", micros("created_at"), (F.col("status") == "forgotten").cast("int")),
        rows(sessions, "session", micros("session_start"), F.col("focused_time_seconds"), F.col("context_switch_count")),
    ]
    d = reduce(DataFrame.unionByName, parts).withColumns({"_s": F.col("x"), "_n": F.col("x").isNotNull().cast("long")})
    if chunk is not None:
        d = in_chunks(d, chunk, max(7, switch_days) * DAY)
        history = carried(d.where(F.col("kind").isin("interruption", "recovery")), ["kind"], {"_s": F.sum, "_n": F.sum})
        d = d.withColumns({c: F.when(~F.col("_halo"), F.col(c)) for c in ("_s", "_n")} | {"_carry": F.lit(False)}).unionByName(history, allowMissingColumns=True)
    user = Window.partitionBy("user_id", *([] if chunk is None else ["_chunk"])).orderBy("_t")
    all_, day, week, switch = (user.rangeBetween(lo, -1) for lo in (Window.unboundedPreceding, -DAY, -7 * DAY, -switch_days * DAY))
    is_ = lambda k: F.col("kind") == k
    mean = lambda k: r6(rate(F.sum(F.when(is_(k), F.col("_s"))).over(all_), F.sum(F.when(is_(k), F.col("_n"))).over(all_)))
    d = d.withColumns({
        "interruptions_today": F.count(F.when(is_("interruption"), 1)).over(day),
        "avg_interruption_s": mean("interruption"),
        "recent_context_switches": F.count(F.when(is_("resumed"), 1)).over(switch),
        "recovery_time_s": mean("recovery"),
        "avg_session_7d_s": r6(F.avg(F.when(is_("session"), F.col("x"))).over(week)),
        "switch_rate_7d": r6(F.avg(F.when(is_("session"), F.col("y"))).over(week)),
        "_lost": F.avg(F.when(is_("task"), F.col("x"))).over(week),
        "_ni": F.count(F.when(is_("interruption"), 1)).over(week),
        "_h": F.sum(F.when(is_("session"), F.col("x"))).over(week) / 3600,
    })
    per_hour = F.when(F.col("_h") > 0, F.col("_ni") / F.col("_h")).otherwise(0.0)
    load = F.least(F.lit(1.0), per_hour / 6)
    d = d.where(is_("point") if chunk is None else is_("point") & ~F.col("_halo")).withColumns({"interruption_load": r6(load), "daily_friction_score": r6(0.6 * F.col("_lost") + 0.4 * load)})
    return d.drop("_t", "kind", "x", "y", "_s", "_n", "_ni", "_h", "_lost", "_chunk", "_end", "_halo", "_carry")


def user_features(tasks: DataFrame, interruptions: DataFrame, sessions: DataFrame, as_of: str) -> DataFrame:
    """Each user's rates, totals and mean lengths of what was before a literal time; only users with any of it."""
    now = F.lit(as_of).cast("timestamp")
    lost, done, res = (F.count_if(c) for c in (F.col("status") == "forgotten", F.col("status") == "completed", F.col("status").isin(TERMINAL)))
    t = tasks.where(F.col("created_at") < now).groupBy("user_id").agg(r6(rate(done, res)).alias("completion_rate"), r6(rate(lost, res)).alias("forgetting_rate"), F.count("*").alias("total_tasks"))
    i = interruptions.where(F.col("start_time") < now).groupBy("user_id").agg(F.count("*").alias("total_interruptions"), r6(F.avg("duration_seconds")).alias("avg_interruption_s"))
    s = sessions.where(F.col("session_start") < now).groupBy("user_id").agg(r6(F.avg("focused_time_seconds")).alias("avg_session_s"), F.sum("context_switch_count").alias("total_context_switches"))
    d = t.join(i, "user_id", "full").join(s, "user_id", "full")
    return d.na.fill(0, ["total_tasks", "total_interruptions", "total_context_switches"])


def location_features(tasks: DataFrame, as_of: str) -> DataFrame:
    t = tasks.where((F.col("created_at") < F.lit(as_of).cast("timestamp")) & F.col("location_id").isNotNull())
    return _summary(t, "location_id")


def _summary(t: DataFrame, key: str) -> DataFrame:
    lost, res = F.count_if(F.col("status") == "forgotten"), F.count_if(F.col("status").isin(TERMINAL))
    return t.groupBy(key).agg(F.count("*").alias("tasks"), lost.alias("forgotten"), r6(rate(lost, res)).alias("forgetting_rate"), F.count_distinct("category").alias("categories"))


def online_features(tasks: DataFrame, interruptions: DataFrame, sessions: DataFrame, days: int = 30, recent: int = 30) -> DataFrame:
    """Per task what a live request sees at its creation: counts and rates of the last ``days`` with defaults for users
    without history, the day so far, switches of six hours, and means over the last ``recent`` sessions.

    Tasks, interruptions and sessions are one long frame by user and time, so no user's rows are multiplied."""
    long = ["user_id", "task_id", "category", "t", "day", "kind", "status", "n", "last"]

    def rows(df: DataFrame, kind: str, at: str, **of: Column) -> DataFrame:
        given = {"user_id": F.col("user_id"), "t": micros(at), "day": F.to_date(at), "kind": F.lit(kind)} | of
        empty = {"task_id": "long", "category": "string", "status": "string", "n": "long", "last": "struct<t:bigint,id:bigint,f:bigint,fn:bigint,i:bigint,k:bigint>"}
        return df.select(*[(given[c] if c in given else F.lit(None).cast(empty[c])).alias(c) for c in long])

    back = Window.partitionBy("user_id").orderBy("session_start", "session_id").rowsBetween(1 - recent, 0)
    f = F.col("focused_time_seconds").cast("long")
    totals = {"f": F.sum(F.when(f > 0, f)), "fn": F.count(F.when(f > 0, f)), "i": F.sum(F.col("interruption_time_seconds").cast("long")), "k": F.sum(F.col("interruption_count").cast("long"))}
    s = sessions.withColumns({f"_{k}": F.coalesce(v.over(back), F.lit(0)) for k, v in totals.items()})
    last = F.struct(micros("session_start").alias("t"), F.col("session_id").cast("long").alias("id"), *[F.col(f"_{k}").alias(k) for k in totals])
    d = rows(tasks, "task", "created_at", task_id=F.col("task_id").cast("long"), category=F.col("category"), status=F.col("status"))
    d = d.unionByName(rows(interruptions, "interruption", "start_time")).unionByName(rows(s, "session", "session_start", n=F.col("context_switch_count").cast("long"), last=last))
    user = Window.partitionBy("user_id").orderBy("t")
    month, hours, ever = (user.rangeBetween(lo, -1) for lo in (-days * DAY, -DAY // 4, Window.unboundedPreceding))
    today = Window.partitionBy("user_id", "day").orderBy("t").rangeBetween(Window.unboundedPreceding, -1)
    like = Window.partitionBy("user_id", "category").orderBy("t").rangeBetween(-days * DAY, -1)
    is_ = lambda k: F.col("kind") == k
    n = lambda cond, w: F.count(F.when(cond, 1)).over(w)
    d = d.withColumns({
        "previous_completion_count": n(F.col("status") == "completed", month),
        "previous_forgetting_count": n(F.col("status") == "forgotten", month),
        "_same": n(is_("task"), like),
        "tasks_today": n(is_("task"), today),
        "interruptions_today": n(is_("interruption"), today),
        "recent_context_switches": F.coalesce(F.sum(F.when(is_("session"), F.col("n"))).over(hours), F.lit(0)),
        "_last": F.max("last").over(ever),
    }).where(is_("task"))
    done, lost = F.col("previous_completion_count"), F.col("previous_forgetting_count")
    total, x = done + lost, lambda c: F.col(f"_last.{c}")
    at = tasks.select("task_id", hours_between("deadline_at", "created_at").alias("_h"), F.weekday("created_at").alias("weekday"), F.hour("created_at").alias("hour"))
    out = d.select("task_id", "previous_completion_count", "previous_forgetting_count", r6(F.coalesce(rate(done, total), F.lit(0.6))).alias("completion_rate"), r6(F.coalesce(rate(lost, total), F.lit(0.2))).alias("forgetting_rate"), r6(F.coalesce(F.least(F.lit(1.0), rate(F.when(F.col("category").isNotNull(), F.col("_same")).otherwise(0), total)), F.lit(0.0))).alias("task_frequency"), "tasks_today", "interruptions_today", "recent_context_switches", r6(F.coalesce(rate(x("f"), x("fn")) / 60, F.lit(20.0))).alias("avg_session_minutes"), r6(F.when(F.col("_last").isNull(), 10.0).otherwise(x("i") / F.greatest(F.lit(1), x("k")) / 60)).alias("avg_interruption_minutes"))
    return out.join(at, "task_id").withColumn("deadline_hours", r6(F.coalesce(F.greatest(F.lit(0.0), F.col("_h")), F.lit(72.0)))).drop("_h")
