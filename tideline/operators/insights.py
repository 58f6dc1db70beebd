"""Insights: one row per user and insight (user_id, insight, risk, evidence: map of doubles, subjects: map of what the
evidence of the same name is about, such as weekdays, hours, categories and locations)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import r6, rate0, seconds_between
from .metrics import forgetting_rate, resolved
from .vocabulary import TERMINAL


DAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def _out(df: DataFrame, insight: str, risk: Column, subjects: dict[str, Column] | None = None, **evidence: Column) -> DataFrame:
    ev = F.map_from_arrays(F.array(*map(F.lit, evidence)), F.array(*[r6(v.cast("double")) for v in evidence.values()]))
    none = F.array().cast("array<string>")
    names = subjects or {}
    about = F.map_from_arrays(F.array(*map(F.lit, names)).cast("array<string>"), F.array(*[F.coalesce(v, none) for v in names.values()]).cast("array<array<string>>"))
    return df.select("user_id", F.lit(insight).alias("insight"), risk.alias("risk"), ev.alias("evidence"), about.alias("subjects"))


def _over(rates: DataFrame, own: DataFrame, times: float, name: str) -> DataFrame:
    """(user_id, name, name_of): how many of a user's groups (b, rate) are over ``times`` their own rate, and which, in order."""
    d = rates.join(own.select("user_id", "own"), "user_id").where(F.col("rate") > times * F.col("own"))
    return d.groupBy("user_id").agg(F.count("*").alias(name), F.array_sort(F.collect_list("b")).alias(f"{name}_of"))


def _levels(high: Column, medium: Column) -> Column:
    return F.when(high, "HIGH").when(medium, "MEDIUM").otherwise("LOW")


def _rates(tasks: DataFrame, *keys: Column) -> DataFrame:
    return tasks.groupBy("user_id", *keys).agg(forgetting_rate().alias("rate"))


def forgetting_timing(tasks: DataFrame, times: float = 1.5) -> DataFrame:
    """Weekdays and hours whose forgetting rate is over ``times`` the user's."""
    own = _rates(tasks).withColumnRenamed("rate", "own")
    over = lambda key, name: _over(_rates(tasks, key.alias("b")), own, times, name)
    d = own.join(over(F.weekday("created_at"), "days"), "user_id", "left").join(over(F.hour("created_at"), "hours"), "user_id", "left").na.fill(0, ["days", "hours"])
    named = {"weekdays": F.transform("days_of", lambda x: F.element_at(F.array(*map(F.lit, DAYS)), x + 1)), "hours": F.col("hours_of").cast("array<string>")}
    return _out(d, "forgetting_timing", _levels(F.col("days") > 2, F.col("days") >= 1), named, overall=F.col("own"), weekdays=F.col("days"), hours=F.col("hours"))


def context_forgetting(tasks: DataFrame, times: float = 1.3) -> DataFrame:
    """Categories and locations whose forgetting rate is over ``times`` the user's."""
    own = _rates(tasks).withColumnRenamed("rate", "own")
    over = lambda key: _over(_rates(tasks.where(F.col(key).isNotNull()), F.col(key).alias("b")), own, times, f"n_{key}")
    d = own.join(over("category"), "user_id", "left").join(over("location_id"), "user_id", "left").na.fill(0, ["n_category", "n_location_id"])
    named = {"categories": F.col("n_category_of"), "locations": F.col("n_location_id_of").cast("array<string>")}
    return _out(d, "context_forgetting", _levels(F.col("n_category") > 1, F.col("n_category") == 1), named, overall=F.col("own"), categories=F.col("n_category"), locations=F.col("n_location_id"))


def _peak(rows: DataFrame, key: Column, value: Column, name: str) -> DataFrame:
    """(user_id, name, name_at): the largest value of a key's groups, and the first key that has it."""
    per = rows.groupBy("user_id", key.alias("_k")).agg(value.alias("_v"))
    return per.groupBy("user_id").agg(F.max("_v").alias(name), F.max_by("_k", F.struct("_v", -F.col("_k"))).alias(f"{name}_at"), F.avg("_v").alias(f"{name}_mean"))


def switch_timing(sessions: DataFrame) -> DataFrame:
    """Switches a session by weekday and by hour: the peaks against the average; the weekday's decides the risk."""
    own = sessions.groupBy("user_id").agg(F.avg("context_switch_count").alias("own"))
    d = own.join(_peak(sessions, F.weekday("session_start"), F.avg("context_switch_count"), "day"), "user_id").join(_peak(sessions, F.hour("session_start"), F.avg("context_switch_count"), "hour"), "user_id")
    risk = F.when(F.col("day") > 2 * F.col("own"), "HIGH").otherwise("MEDIUM")
    return _out(d, "switch_timing", risk, average=F.col("own"), weekday=F.col("day_at"), weekday_peak=F.col("day"), hour=F.col("hour_at"), hour_peak=F.col("hour"))


def interruption_cost(base: DataFrame) -> DataFrame:
    hours = F.col("interruption_s") / 3600 + F.col("switches") * 5 / 60
    return _out(base, "interruption_cost", _levels(hours > 2, hours > 1), hours_lost=hours, share=rate0(hours, F.col("active_s") / 3600))


def recurring_delay(tasks: DataFrame, times: float = 1.3) -> DataFrame:
    """Share completed after the deadline, and the categories and priorities where it is over ``times`` the user's; the
    number of such categories decides the risk."""
    done = tasks.where("status = 'completed' AND deadline_at IS NOT NULL AND completed_at IS NOT NULL").withColumn("late", (F.col("completed_at") > F.col("deadline_at")).cast("int"))
    own = done.groupBy("user_id").agg(F.avg("late").alias("own"), F.count("*").alias("n"))
    over = lambda key: _over(done.groupBy("user_id", F.col(key).alias("b")).agg(F.avg("late").alias("rate")), own, times, f"n_{key}")
    d = own.join(over("category"), "user_id", "left").join(over("priority"), "user_id", "left").na.fill(0, ["n_category", "n_priority"])
    named = {"categories": F.col("n_category_of"), "priorities": F.col("n_priority_of").cast("array<string>")}
    return _out(d, "recurring_delay", _levels(F.col("n_category") > 1, F.col("n_category") == 1), named, late_share=F.col("own"), categories=F.col("n_category"), priorities=F.col("n_priority"), tasks=F.col("n"))


def primary_locations(tasks: DataFrame) -> DataFrame:
    """(user_id, category, location_id, share): where each category's located tasks mostly are; the lower id at ties."""
    per = tasks.where(F.col("location_id").isNotNull()).groupBy("user_id", "category", "location_id").agg(F.count("*").alias("n"))
    return per.groupBy("user_id", "category").agg(F.max_by("location_id", F.struct("n", -F.col("location_id"))).alias("location_id"), (F.max("n") / F.sum("n")).alias("share"))


def context_association(tasks: DataFrame) -> DataFrame:
    """How strongly categories belong to their primary location; the weakest decides the risk."""
    d = primary_locations(tasks).groupBy("user_id").agg(F.min("share").alias("weakest"), F.max("share").alias("strongest"), F.avg("share").alias("mean"), F.min_by("location_id", F.struct(-F.col("share"), "category")).alias("at"), F.count("*").alias("categories"))
    return _out(d, "context_association", F.when(F.col("weakest") < 0.3, "MEDIUM").otherwise("LOW"), weakest=F.col("weakest"), strongest=F.col("strongest"), strongest_location=F.col("at"), average=F.col("mean"), categories=F.col("categories"))


def friction_timing(sessions: DataFrame) -> DataFrame:
    """(2 * switches + interruptions) per active hour, by weekday and by hour; the weekday's peak against the mean of
    weekdays decides the risk."""
    active = F.sum(F.col("focused_time_seconds") + F.col("interruption_time_seconds")) / 3600
    value = rate0(2 * F.sum("context_switch_count") + F.sum("interruption_count"), active)
    d = _peak(sessions, F.weekday("session_start"), value, "day").join(_peak(sessions, F.hour("session_start"), value, "hour"), "user_id")
    risk = F.when(F.col("day") > 2 * F.col("day_mean"), "HIGH").otherwise("MEDIUM")
    return _out(d, "friction_timing", risk, average=F.col("day_mean"), weekday=F.col("day_at"), weekday_peak=F.col("day"), hour=F.col("hour_at"), hour_peak=F.col("hour"))


def behaviour_trend(tasks: DataFrame, least: int = 7) -> DataFrame:
    """Slope of the daily forgetting rate against the position of the day, with at least ``least`` days."""
    day = tasks.where(resolved()).groupBy("user_id", F.to_date("created_at").alias("day")).agg(F.avg((F.col("status") == "forgotten").cast("double")).alias("rate"))
    d = day.withColumn("i", (F.row_number().over(Window.partitionBy("user_id").orderBy("day")) - 1).cast("double"))
    d = d.groupBy("user_id").agg(F.count("*").alias("days"), F.regr_slope("rate", "i").alias("slope")).where(F.col("days") >= least)
    return _out(d, "behaviour_trend", _levels(F.col("slope") > 0.005, F.col("slope") > 0.001), slope=F.col("slope"), days=F.col("days"))


def category_friction(tasks: DataFrame, sessions: DataFrame, interruptions: DataFrame) -> DataFrame:
    """forgetting * 100 + density * 10 + switching * 20 by (user, task group); the category of the peak, and the
    peak against the mean."""
    keys = ["user_id", "category"]
    s = sessions.groupBy(*keys).agg(F.sum("context_switch_count").alias("sw"), F.count("*").alias("n"), (F.sum(F.col("focused_time_seconds") + F.col("interruption_time_seconds")) / 3600).alias("h"))
    i = interruptions.groupBy(*keys).agg(F.count("*").alias("i"))
    t = tasks.groupBy(*keys).agg(forgetting_rate().alias("f"))
    v = s.join(t, keys).join(i, keys, "left").select("user_id", "category", (F.col("f") * 100 + rate0(F.coalesce("i", F.lit(0)), F.col("h")) * 10 + F.col("sw") / F.col("n") * 20).alias("v"))
    d = v.groupBy("user_id").agg(F.avg("v").alias("mean"), F.max("v").alias("peak"), F.min_by("category", F.struct(-F.col("v"), "category")).alias("worst"))
    return _out(d, "category_friction", F.when(F.col("peak") > 1.5 * F.col("mean"), "HIGH").otherwise("MEDIUM"), {"peak": F.array("worst")}, average=F.col("mean"), peak=F.col("peak"))


def attention(tasks: DataFrame, as_of: str, top: int = 5) -> DataFrame:
    """Open tasks that need attention: priority, deadline and category risk; over 0.5, the first five of each user."""
    cat = tasks.groupBy("user_id", "category").agg(forgetting_rate().alias("cat_rate"))
    days = seconds_between(F.lit(as_of).cast("timestamp"), "deadline_at") / -86400
    score = F.when(F.col("priority") >= 4, 0.3).when(F.col("priority") == 3, 0.15).otherwise(0.0) + F.when(days < 1, 0.4).when(days < 3, 0.2).otherwise(0.0) + F.when(F.col("cat_rate") > 0.3, 0.2).otherwise(0.0)
    d = tasks.where(~F.col("status").isin(TERMINAL)).join(cat, ["user_id", "category"]).withColumn("risk_score", F.round(score, 4)).where("risk_score > 0.5")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("risk_score"), "task_id"))
    return d.withColumn("position", n).where(F.col("position") <= top).select("user_id", "task_id", "risk_score", "position")


def attention_insight(tasks: DataFrame, as_of: str) -> DataFrame:
    """Users with open tasks: how many need attention, and the highest score."""
    open_ = tasks.where(~F.col("status").isin(TERMINAL)).groupBy("user_id").agg(F.count("*").alias("active"))
    found = attention(tasks, as_of).groupBy("user_id").agg(F.count("*").alias("n"), F.max("risk_score").alias("top"))
    d = open_.join(found, "user_id", "left").na.fill(0, ["n", "top"])
    return _out(d, "proactive_attention", _levels(F.col("n") > 2, F.col("n") >= 1), active_tasks=F.col("active"), tasks=F.col("n"), top_score=F.col("top"))


#: The order of insights in a story, and what each suggests.
ADVICE = {
    "forgetting_timing": "Keep important tasks out of the weekdays and hours named.",
    "context_forgetting": "Change the surroundings or the owner of tasks in the contexts named.",
    "category_friction": "Improve the category with the most friction first.",
    "switch_timing": "Put focused work where switches are fewest.",
    "interruption_cost": "Block time for focus and mute notifications in it.",
    "recurring_delay": "Plan more time for the categories that are late.",
    "context_association": "Plan tasks where they are mostly done.",
    "friction_timing": "Put demanding tasks where friction is lowest.",
    "behaviour_trend": "Watch the trend and look into what makes it worse.",
    "proactive_attention": "Take the tasks with the highest scores first.",
}


def story(insights: DataFrame) -> DataFrame:
    """Per user, in the fixed order of insights: a narrative, the first three findings, the high risks and the first three
    recommendations. A finding or risk names what the insight is about."""
    names = F.array(*map(F.lit, ADVICE))
    advice = F.array(*map(F.lit, ADVICE.values()))
    of = F.array_join(F.flatten(F.transform(F.array_sort(F.map_keys("subjects")), lambda k: F.col("subjects")[k])), ", ")
    d = insights.withColumns({"o": F.array_position(names, F.col("insight")).cast("int"), "of": F.nullif(of, F.lit(""))})
    d = d.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("o", "insight", "risk", "of"))).alias("s"))
    high = F.filter("s", lambda x: x["risk"] == "HIGH")
    text = lambda c, f, n=100: F.array_join(F.slice(F.transform(c, f), 1, n), "; ")
    narrative = F.when(F.size(high) > 0, F.concat(F.size(high).cast("string"), F.lit(" patterns of high risk need attention."))).otherwise("No pattern of high risk.")
    return d.select("user_id", F.size("s").cast("long").alias("insights"), F.size(high).cast("long").alias("high"), F.size(F.filter("s", lambda x: x["risk"] == "MEDIUM")).cast("long").alias("medium"), narrative.alias("narrative"), text("s", lambda x: F.concat_ws(": ", x["insight"], F.lower(x["risk"]), x["of"]), 3).alias("findings"), text(high, lambda x: F.concat_ws(": ", x["insight"], x["of"])).alias("risks"), text("s", lambda x: F.element_at(advice, x["o"]), 3).alias("recommendations"))


def all_insights(*tables: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)
