"""Queries over sessions, metrics and composite scores, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean, metrics, sessions
from .prepare import _CLEAN_I
from .views import AS_OF_EVENTS, AS_OF_TASKS, view, with_views


def _interruptions(spark, sf):
    return clean.clean_interruptions(view(spark, sf, "interruptions"))


def _sessions(spark, sf):
    return sessions.measured_sessions(sessions.lifecycle_sessions(view(spark, sf, "task_events"), AS_OF_EVENTS), _interruptions(spark, sf))


def _status(spark, sf):
    return sessions.latest_status(view(spark, sf, "task_events"))


def _tasks_of_events(spark, sf):
    """Latest status with a category (the part type that the task's number gives), a place and a deadline."""
    part = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("_p"), F.col("p_type").alias("category"))
    first = view(spark, sf, "task_events").groupBy("user_id", "task_id").agg(F.min_by("location_id", F.struct("event_time", "id")).alias("location_id"))
    d = _status(spark, sf).withColumn("_p", F.col("task_id") % 200 + 1).join(part, "_p", "left").drop("_p").join(first, ["user_id", "task_id"])
    return d.withColumn("deadline_at", F.timestamp_micros(F.unix_micros("created_at") + F.lit(29 * 86_400_000_000)))


def _flat_map(c):
    return F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda x: F.concat_ws("=", x["key"], F.round(x["value"].cast("double"), 4).cast("string"))), ",")


def overview(spark, sf):
    d = metrics.overview(_tasks_of_events(spark, sf), _interruptions(spark, sf), _sessions(spark, sf), view(spark, sf, "task_events"), "2024-01-01", 30)
    return d.select(*[_flat_map(F.col(c)).alias(c) if k.startswith("map") else F.col(c) for c, k in d.dtypes])


def _status_by_place(spark, sf):
    """Events as tasks of a category, so that a month has many of them: one for each event."""
    return view(spark, sf, "task_events").select((F.col("user_id") % 20).alias("user_id"), F.concat(F.lit("c"), F.col("location_id").cast("string")).alias("category"), F.col("event_time").alias("created_at"))


def _base(spark, sf):
    return metrics.base_by_user(_status(spark, sf), _interruptions(spark, sf), _sessions(spark, sf))


def friction_by_user(spark, sf):
    return metrics.friction(_base(spark, sf))


def _ctx(spark, sf):
    return sessions.context_sessions(view(spark, sf, "context_events"))


def _daily(spark, sf):
    return metrics.daily_rollup(_status(spark, sf), _interruptions(spark, sf), _sessions(spark, sf))


def _upsert(spark, sf):
    d = metrics.dimension_rollup(view(spark, sf, "tasks")).withColumn("computed_at", F.lit(1))
    new = d.where("user_id % 3 = 0").withColumns({"value": F.col("value") + 1, "computed_at": F.lit(2)})
    return metrics.upsert(d, new, ["user_id", "dimension", "metric_name"], "computed_at")


_OPEN, _CLOSE = "('created', 'started', 'resumed')", "('paused', 'completed', 'forgotten', 'cancelled')"
S = f"""n AS (SELECT *, lead(event_type) OVER w AS nx, lead(event_time) OVER w AS nt, lag(event_type) OVER w AS pv FROM task_events WINDOW w AS (PARTITION BY task_id ORDER BY event_time, id)),
 n2 AS (SELECT *, last_value(CASE WHEN event_type = 'paused' AND pv IN {_OPEN} THEN event_time END IGNORE NULLS) OVER (PARTITION BY task_id ORDER BY event_time, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pt FROM n),
 ses AS (SELECT id AS session_id, user_id, task_id, location_id, event_time AS session_start, coalesce(nt, greatest(event_time, least(event_time + INTERVAL 30 MINUTE, TIMESTAMP '{AS_OF_EVENTS}'))) AS session_end,
   CASE WHEN event_type = 'resumed' THEN (epoch_us(event_time) - epoch_us(pt)) / 1e6 END AS resume_delay_seconds FROM n2 WHERE event_type IN {_OPEN} AND (nx IS NULL OR nx IN {_CLOSE})),
 {_CLEAN_I},
 hit AS (SELECT session_id, CAST(sum(CAST(floor((epoch_us(least(coalesce(end_time, start_time), session_end)) - epoch_us(greatest(start_time, session_start))) / 1e6) AS BIGINT)) AS BIGINT) AS it, count(*) FILTER (coalesce(duration_seconds, 0) >= 300) AS sw, count(*) AS ic
   FROM ses JOIN ci ON ses.task_id = ci.task_id AND start_time < session_end AND coalesce(end_time, start_time) > session_start GROUP BY session_id),
 ms AS (SELECT ses.*, coalesce(it, 0) AS interruption_time_seconds, coalesce(sw, 0) AS context_switch_count, coalesce(ic, 0) AS interruption_count,
   CAST(greatest(0, floor((epoch_us(session_end) - epoch_us(session_start)) / 1e6) - coalesce(it, 0)) AS BIGINT) AS focused_time_seconds FROM ses LEFT JOIN hit USING (session_id))"""
ST = """st AS (SELECT user_id, task_id, status, created_at, started_at, CASE WHEN status = 'completed' THEN ended_at END AS completed_at FROM (SELECT user_id, task_id, arg_max(event_type, (event_time, id)) AS status, min(event_time) AS created_at, min(event_time) FILTER (event_type = 'started') AS started_at, max(event_time) FILTER (event_type = 'completed') AS ended_at FROM task_events GROUP BY ALL))"""
_RES = "('completed', 'forgotten', 'cancelled')"
_RATE = f"coalesce(count(*) FILTER (status = '{{}}') / nullif(count(*) FILTER (status IN {_RES}), 0)::DOUBLE, 0)"
LOST, DONE = _RATE.format("forgotten"), _RATE.format("completed")
BASE = f"""{S}, {ST}, bt AS (SELECT user_id, {LOST} AS forget, count(*) AS tasks FROM st GROUP BY user_id),
 bi AS (SELECT user_id, count(*) AS n, sum(coalesce(duration_seconds, 0)) AS s FROM ci GROUP BY user_id),
 bs AS (SELECT user_id, count(*) AS sessions, sum(context_switch_count) AS switches, avg(resume_delay_seconds) AS delay, sum(focused_time_seconds + interruption_time_seconds) AS active_s FROM ms GROUP BY user_id),
 base AS (SELECT user_id, forget, tasks, coalesce(n, 0) AS interruptions, coalesce(s, 0) AS interruption_s, coalesce(sessions, 0) AS sessions, coalesce(switches, 0) AS switches, delay, coalesce(active_s, 0) AS active_s FROM bt LEFT JOIN bi USING (user_id) LEFT JOIN bs USING (user_id))"""
_PH = "coalesce(interruptions / nullif(active_s / 3600.0, 0), 0)"
_PS = "coalesce(switches / nullif(sessions, 0)::DOUBLE, 0)"


def _friction(h, p, m, f):
    sat = lambda x, full: f"least(greatest({x} / {full} * 100, 0), 100)"
    return f"""WITH {BASE}, x AS (SELECT user_id, least(forget * {f}, 100) AS a, {sat(_PH, h)} AS b, {sat(_PS, p)} AS c, {sat('coalesce(delay / 60, 0)', m)} AS d FROM base)
      SELECT user_id, round(a, 6) AS forgetting, round(b, 6) AS interruption, round(c, 6) AS switching, round(d, 6) AS recovery, round(0.35 * a + 0.25 * b + 0.2 * c + 0.2 * d, 6) AS friction FROM x"""


CTX = """o AS (SELECT *, CASE WHEN event_type = 'START' OR lag(event_type) OVER w IS NULL OR lag(event_type) OVER w = 'COMPLETE' THEN 1 ELSE 0 END AS op FROM context_events WINDOW w AS (PARTITION BY user_id, task_id ORDER BY ts, id)),
 q AS (SELECT *, sum(op) OVER (PARTITION BY user_id, task_id ORDER BY ts, id) AS seq FROM o),
 g AS (SELECT *, (epoch_us(ts) - epoch_us(lag(ts) OVER s)) / 1e6 AS gap, coalesce(sum(CASE WHEN event_type = 'RESUME' THEN 1 ELSE 0 END) OVER (s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ep FROM q WINDOW s AS (PARTITION BY user_id, task_id, seq ORDER BY ts, id)),
 p AS (SELECT *, max(CASE WHEN event_type = 'INTERRUPTION' THEN ts END) OVER (PARTITION BY user_id, task_id, seq, ep ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pend FROM g),
 f AS (SELECT *, CASE WHEN event_type IN ('INTERRUPTION', 'PAUSE', 'TASK_SWITCH') OR (event_type = 'COMPLETE' AND pend IS NULL) THEN coalesce(gap, 0) ELSE 0 END AS focus, CASE WHEN event_type IN ('RESUME', 'COMPLETE') THEN (epoch_us(ts) - epoch_us(pend)) / 1e6 END AS lost FROM p),
 cs AS (SELECT user_id, task_id, CAST(seq AS BIGINT) AS seq, arg_min(task_category, (ts, id)) AS task_category, arg_min(context, (ts, id)) AS context, min(ts) AS start_time, max(ts) AS end_time, round(sum(focus), 3) AS focused_time_seconds, round(coalesce(sum(lost), 0), 3) AS interruption_time_seconds,
   count(*) FILTER (event_type = 'INTERRUPTION') AS num_interruptions, count(*) FILTER (event_type = 'TASK_SWITCH') AS num_context_switches, coalesce(list(lost ORDER BY ts, id) FILTER (event_type = 'RESUME' AND lost IS NOT NULL), []) AS resume_delays_seconds, coalesce(list(lost ORDER BY ts, id) FILTER (lost IS NOT NULL), []) AS interruption_durations_seconds,
   bool_or(event_type = 'COMPLETE') AS completed, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS session_duration_seconds FROM f GROUP BY user_id, task_id, seq)"""
SF = """sf AS (SELECT user_id, task_id, seq, session_duration_seconds, focused_time_seconds, coalesce(list_avg(resume_delays_seconds), 0) AS avg_resume_delay, coalesce(list_avg(interruption_durations_seconds), 0) AS avg_interruption, num_interruptions, num_context_switches, CAST(hour(start_time) AS INT) AS hour, CAST(isodow(start_time) - 1 AS INT) AS weekday, interruption_time_seconds FROM cs)"""
_TM = f"count(*) AS tasks, round({DONE}, 6) AS completion_rate, round({LOST}, 6) AS forgetting_rate, round(avg(CASE WHEN status = 'completed' THEN (epoch_us(completed_at) - epoch_us(started_at)) / 6e7 END), 6) AS avg_minutes, round(avg(CASE WHEN status = 'completed' THEN (epoch_us(completed_at) - epoch_us(deadline_at)) / 6e7 END), 6) AS avg_delay_minutes"
_SM = "count(*) AS sessions, round(avg(focused_time_seconds) / 60, 6) AS avg_focus_minutes, CAST(sum(context_switch_count) AS BIGINT) AS switches, count(resume_delay_seconds) AS resumes, round(avg(resume_delay_seconds), 6) AS avg_resume_delay, CAST(sum(focused_time_seconds) AS BIGINT) AS focused, CAST(sum(interruption_time_seconds) AS BIGINT) AS interrupted"
_IM = "count(*) AS interruptions, round(sum(coalesce(duration_seconds, 0)) / 60, 6) AS total_minutes, round(avg(coalesce(duration_seconds, 0)) / 60, 6) AS avg_minutes"
_LONG = "SELECT user_id, {key}, metric_name, round(value, 6) AS value FROM {src} UNPIVOT (value FOR metric_name IN ({cols}))"
_SAT = lambda x, full: f"least(greatest({x} / {full} * 100, 0), 100)"
DAILY = f"""dt AS (SELECT user_id, CAST(created_at AS DATE) AS period_start, CAST(count(*) AS DOUBLE) AS task_count, {DONE} * 100 AS completion_rate, {LOST} * 100 AS forgetting_rate FROM st GROUP BY ALL),
 di AS (SELECT user_id, CAST(start_time AS DATE) AS period_start, CAST(count(*) AS DOUBLE) AS c FROM ci GROUP BY ALL),
 ds AS (SELECT user_id, CAST(session_start AS DATE) AS period_start, count(*) AS sessions, sum(context_switch_count) AS switches, avg(resume_delay_seconds) AS delay, sum(focused_time_seconds + interruption_time_seconds) AS active_s FROM ms GROUP BY ALL),
 d0 AS (SELECT dt.*, coalesce(c, 0) AS interruption_count, coalesce(c, 0) AS interruptions, coalesce(sessions, 0) AS sessions, coalesce(switches, 0) AS switches, delay, coalesce(active_s, 0) AS active_s FROM dt LEFT JOIN di USING (user_id, period_start) LEFT JOIN ds USING (user_id, period_start)),
 dd AS (SELECT user_id, period_start, task_count, completion_rate, forgetting_rate, interruption_count, 0.35 * least(forgetting_rate, 100) + 0.25 * {_SAT(_PH, 6)} + 0.2 * {_SAT(_PS, 3)} + 0.2 * {_SAT('coalesce(delay / 60, 0)', 30)} AS friction_score FROM d0),
 dl AS ({_LONG.format(key='period_start', src='dd', cols='task_count, completion_rate, forgetting_rate, interruption_count, friction_score')})"""
STC = f"""{S}, {ST}, fl AS (SELECT user_id, task_id, arg_min(location_id, (event_time, id)) AS location_id FROM task_events GROUP BY ALL),
 et AS (SELECT st.*, p_type AS category, location_id, st.created_at + INTERVAL 29 DAY AS deadline_at FROM st JOIN fl USING (user_id, task_id) LEFT JOIN part ON p_partkey = task_id % 200 + 1)"""
_TXT = "string_agg(k || '=' || CAST(round(CAST(v AS DOUBLE), 4) AS VARCHAR), ',' ORDER BY k)"


def _bd(name, src, key, value):
    return f"{name} AS (SELECT user_id, {_TXT} AS {name} FROM (SELECT user_id, CAST({key} AS VARCHAR) AS k, {value} AS v FROM {src} WHERE {key} IS NOT NULL GROUP BY ALL) GROUP BY user_id)"


_MAPS = [
    ("tasks_by_category", "t", "category", "count(*)"), ("tasks_by_location_id", "t", "location_id", "count(*)"),
    ("forgetting_by_weekday", "t", "isodow(created_at) - 1", f"round({LOST}, 6)"), ("forgetting_by_hour", "t", "hour(created_at)", f"round({LOST}, 6)"),
    ("forgetting_by_category", "t", "category", f"round({LOST}, 6)"), ("forgetting_by_location_id", "t", "location_id", f"round({LOST}, 6)"),
    ("interruptions_by_weekday", "i", "isodow(start_time) - 1", "count(*)"), ("interruptions_by_hour", "i", "hour(start_time)", "count(*)"), ("interruptions_by_type", "i", "interruption_type", "count(*)"),
    ("switches_by_category", "(SELECT s.user_id, context_switch_count, category FROM s JOIN et USING (task_id))", "category", "sum(context_switch_count)"), ("switches_by_location_id", "s", "location_id", "sum(context_switch_count)"),
]
DIM = f"""c2 AS (SELECT user_id, CASE WHEN grouping(category) = 0 THEN 'category:' || category ELSE 'location:' || CAST(location_id AS VARCHAR) END AS dimension, CAST(count(*) AS DOUBLE) AS task_count, {DONE} * 100 AS completion_rate, {LOST} * 100 AS forgetting_rate FROM tasks GROUP BY GROUPING SETS ((user_id, category), (user_id, location_id))),
 dm AS ({_LONG.format(key='dimension', src='c2', cols='task_count, completion_rate, forgetting_rate')})"""
EV, BOTH = ("task_events", "interruptions"), ("task_events", "interruptions")
_T = lambda s, sf: view(s, sf, "tasks")
_KEYS = {"user": ("user_id", "user_id"), "category": ("category", "category"), "location": ("location_id", "location_id"), "weekday": (F.weekday, "CAST(isodow(created_at) - 1 AS INT)"), "hour": (F.hour, "CAST(hour(created_at) AS INT)"), "day": (F.to_date, "CAST(created_at AS DATE)")}
_IKEYS = {"user": ("user_id", "user_id"), "type": ("interruption_type", "interruption_type"), "weekday": (F.weekday, "CAST(isodow(start_time) - 1 AS INT)"), "hour": (F.hour, "CAST(hour(start_time) AS INT)")}


def _by(op, source, stamp, key, name):
    def run(spark, sf):
        d = source(spark, sf)
        return op(d.withColumn("bucket", key(stamp) if callable(key) else F.col(key)), "bucket")

    return run


QUERIES = {
    "r_lifecycle_sessions": _sessions,
    "r7_untied_sessions": lambda s, sf: sessions.measured_sessions(sessions.lifecycle_sessions(view(s, sf, "task_events"), AS_OF_EVENTS), _interruptions(s, sf), "same_user"),
    "r_latest_status": _status,
    "r8_context_sessions": _ctx,
    "r12_session_totals": lambda s, sf: sessions.session_totals(_ctx(s, sf), "task_category", "context").select("task_category", "context", "sessions", *[F.round(c, 4).alias(c) for c in ("focused", "interrupted", "avg_resume_delay", "switches_per_hour", "interruptions_per_session")], "switches", "interruptions"),
    "r13_session_features": lambda s, sf: sessions.session_features(_ctx(s, sf)),
    "r14_recovery_cost": lambda s, sf: sessions.recovery_cost(_ctx(s, sf)),
    "r15_visits": lambda s, sf: sessions.visits(view(s, sf, "context_events"), 1440),
    "r15_visits_60m": lambda s, sf: sessions.visits(view(s, sf, "context_events")),
    "r16_switch_timeline": lambda s, sf: sessions.switch_timeline(view(s, sf, "task_events"), view(s, sf, "interruptions"), _tasks_of_events(s, sf)),
    "m9_session_metrics": lambda s, sf: metrics.focus_metrics(_sessions(s, sf), view(s, sf, "task_events"), "user_id"),
    "m11_overview": overview,
    "s9_metric_series": lambda s, sf: metrics.metric_endpoints(metrics.metric_series(_tasks_of_events(s, sf), _sessions(s, sf), _daily(s, sf))),
    "m10_switches_by_location": lambda s, sf: _sessions(s, sf).groupBy("location_id").agg(F.sum("context_switch_count").alias("switches")),
    "m10_switches_by_category": lambda s, sf: metrics.switches_by_category(_sessions(s, sf), _tasks_of_events(s, sf)),
    "m12_heatmap": lambda s, sf: metrics.heatmap(_T(s, sf)),
    "m13_daily_rollup": _daily,
    "m14_dimension_rollup": lambda s, sf: metrics.dimension_rollup(_T(s, sf)),
    "m15_series_summary": lambda s, sf: metrics.series_summary(_daily(s, sf), ["user_id", "metric_name"], "period_start", "value"),
    "k7_upsert": _upsert,
    "d1_friction": friction_by_user,
    "d6_friction_v2": lambda s, sf: metrics.friction_v2(_base(s, sf)),
    "d2_forget_risk": lambda s, sf: metrics.forget_risk(_base(s, sf), _status(s, sf).withColumn("deadline_at", F.timestamp_micros(F.unix_micros("created_at") + F.lit(29 * 86_400_000_000))), AS_OF_EVENTS),
    "d3_windowed_rates": lambda s, sf: metrics.windowed_rates(_sessions(s, sf), _interruptions(s, sf), AS_OF_EVENTS, 72),
    "d3_windowed_rates_24h": lambda s, sf: metrics.windowed_rates(_sessions(s, sf), _interruptions(s, sf), AS_OF_EVENTS),
    "d7_reliability": lambda s, sf: metrics.reliability(_T(s, sf), AS_OF_TASKS),
    "d7_reliability_by_creation": lambda s, sf: metrics.reliability(_T(s, sf), AS_OF_TASKS, 3650, "created_at"),
    "d8_consistency": lambda s, sf: metrics.consistency(_T(s, sf)),
    "d9_repetition": lambda s, sf: metrics.repetition_strength(metrics.repetition(_status_by_place(s, sf), AS_OF_EVENTS)),
    "d9_category_repetition": lambda s, sf: metrics.repetition(_status_by_place(s, sf), AS_OF_EVENTS),
    "d10_time_lost": lambda s, sf: metrics.time_lost(_base(s, sf)),
    **{f"m_tasks_by_{n}": _by(metrics.task_metrics, _T, "created_at", k, n) for n, (k, _) in _KEYS.items()},
    **{f"m_interruptions_by_{n}": _by(metrics.interruption_metrics, _interruptions, "start_time", k, n) for n, (k, _) in _IKEYS.items()},
}
SQL = {
    "r_lifecycle_sessions": with_views(f"WITH {S} SELECT * FROM ms", *BOTH),
    "r7_untied_sessions": with_views("WITH " + S.replace("ON ses.task_id = ci.task_id AND", "ON (ses.task_id = ci.task_id OR (ci.task_id IS NULL AND ses.user_id = ci.user_id)) AND") + " SELECT * FROM ms", *BOTH),
    "r_latest_status": with_views(f"WITH {ST} SELECT * FROM st", "task_events"),
    "r8_context_sessions": with_views(f"WITH {CTX} SELECT * FROM cs", "context_events"),
    "r12_session_totals": with_views(f"""WITH {CTX}, fl AS (SELECT task_category, context, sum(list_sum(resume_delays_seconds)) AS d, sum(len(resume_delays_seconds)) AS n FROM cs GROUP BY ALL),
      t AS (SELECT task_category, context, count(*) AS sessions, sum(focused_time_seconds) AS focused, sum(interruption_time_seconds) AS interrupted, CAST(sum(num_context_switches) AS BIGINT) AS switches, CAST(sum(num_interruptions) AS BIGINT) AS interruptions FROM cs GROUP BY ALL)
      SELECT task_category, context, sessions, round(focused, 4) AS focused, round(interrupted, 4) AS interrupted, round(d / nullif(n, 0), 4) AS avg_resume_delay, round(switches / nullif(focused / 3600, 0), 4) AS switches_per_hour, round(interruptions / sessions, 4) AS interruptions_per_session, switches, interruptions FROM t JOIN fl USING (task_category, context)""", "context_events"),
    "r13_session_features": with_views(f"WITH {CTX}, {SF} SELECT * EXCLUDE (interruption_time_seconds) FROM sf", "context_events"),
    "r14_recovery_cost": with_views(f"WITH {CTX}, {SF}, b AS (SELECT " + ", ".join(f"min({c}) AS l{i}, max({c}) - min({c}) AS r{i}" for i, c in enumerate(sessions.RECOVERY_WEIGHTS)) + " FROM sf) SELECT user_id, task_id, seq, round(" + " + ".join(f"{w} * CASE WHEN r{i} > 1e-9 THEN ({c} - l{i}) / r{i} ELSE 0 END" for i, (c, w) in enumerate(sessions.RECOVERY_WEIGHTS.items())) + ", 6) AS recovery_cost FROM sf, b", "context_events"),
    **{f"r15_visits{suffix}": with_views(f"""WITH n AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) > {gap} OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS nw FROM context_events WHERE event_type = 'COMPLETE' WINDOW w AS (PARTITION BY user_id, context ORDER BY ts, id)),
      v AS (SELECT *, sum(nw) OVER (PARTITION BY user_id, context ORDER BY ts, id) AS visit FROM n), fst AS (SELECT user_id, context, visit, task_id, min((ts, id)) AS o FROM v GROUP BY ALL), st AS (SELECT user_id, context, visit, min(ts) AS visit_start FROM v GROUP BY ALL)
      SELECT user_id, context, CAST(visit AS BIGINT) AS visit, list(task_id ORDER BY o) AS tasks, any_value(visit_start) AS visit_start FROM fst JOIN st USING (user_id, context, visit) GROUP BY ALL""", "context_events") for suffix, gap in (("", 86_400_000_000), ("_60m", 3_600_000_000))},
    "r16_switch_timeline": with_views(f"WITH {STC} SELECT e.id, e.user_id, row_number() OVER (PARTITION BY e.user_id ORDER BY event_time, e.id) AS position, et.category, e.event_type, EXISTS (SELECT 1 FROM interruptions i WHERE e.user_id = i.user_id AND epoch_us(event_time) BETWEEN epoch_us(start_time) AND epoch_us(start_time) + coalesce(duration_seconds, 0) * 1000000) AS in_interruption FROM task_events e LEFT JOIN et ON e.task_id = et.task_id AND e.user_id = et.user_id", *BOTH),
    "m11_overview": with_views(f"WITH {STC}, t AS (SELECT * FROM et WHERE created_at >= TIMESTAMP '2024-01-01'), i AS (SELECT * FROM ci WHERE start_time >= TIMESTAMP '2024-01-01'), s AS (SELECT * FROM ms WHERE session_start >= TIMESTAMP '2024-01-01'), a AS (SELECT user_id, {_TM}, round(count(*) / 30.0, 6) AS tasks_per_day FROM t GROUP BY user_id), b AS (SELECT user_id, count(*) AS interruptions, round(sum(coalesce(duration_seconds, 0)) / 60, 6) AS interruption_minutes, round(avg(coalesce(duration_seconds, 0)) / 60, 6) AS avg_interruption_minutes FROM i GROUP BY user_id), sc AS (SELECT user_id, {_SM} FROM s GROUP BY user_id), pz AS (SELECT user_id, count(*) AS pauses FROM task_events WHERE event_type = 'paused' AND event_time >= TIMESTAMP '2024-01-01' GROUP BY user_id), " + ", ".join(_bd(*m) for m in _MAPS) + " SELECT a.*, coalesce(interruptions, 0) AS interruptions, interruption_minutes, avg_interruption_minutes, coalesce(sessions, 0) AS sessions, avg_focus_minutes, coalesce(switches, 0) AS switches, coalesce(resumes, 0) AS resumes, avg_resume_delay, focused, interrupted, CASE WHEN sc.user_id IS NULL THEN 0 ELSE coalesce(pauses, 0) END AS pauses, " + ", ".join(m[0] for m in _MAPS) + " FROM a LEFT JOIN b USING (user_id) LEFT JOIN sc ON a.user_id = sc.user_id LEFT JOIN pz ON a.user_id = pz.user_id " + " ".join(f"LEFT JOIN {m[0]} ON a.user_id = {m[0]}.user_id" for m in _MAPS), *BOTH),
    "s9_metric_series": with_views(f"WITH {STC}, {DAILY}, x AS (SELECT user_id, 'task_duration' AS metric, CAST(NULL AS DATE) AS day, round((epoch_us(completed_at) - epoch_us(started_at)) / 6e7, 6) AS value FROM et WHERE status = 'completed' AND started_at IS NOT NULL AND completed_at IS NOT NULL UNION ALL SELECT user_id, 'session_duration', NULL, round((focused_time_seconds + interruption_time_seconds) / 60.0, 6) FROM ms UNION ALL SELECT user_id, 'daily_' || metric_name, period_start, value FROM dl WHERE metric_name IN ('forgetting_rate', 'friction_score')), y AS (SELECT *, CASE WHEN day IS NOT NULL THEN row_number() OVER (PARTITION BY user_id, metric ORDER BY day) - 1 END AS i FROM x) SELECT user_id, metric, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high, count(day) > 0 AND count(*) < 5 AS insufficient, CASE WHEN count(day) >= 5 THEN round(regr_slope(value, i), 8) END AS slope FROM y GROUP BY ALL", *BOTH),
    "m9_session_metrics": with_views(f"WITH {S}, pz AS (SELECT user_id, count(*) AS p FROM task_events WHERE event_type = 'paused' GROUP BY user_id), sc AS (SELECT user_id, {_SM} FROM ms GROUP BY user_id) SELECT sc.*, coalesce(p, 0) AS pauses FROM sc LEFT JOIN pz USING (user_id)", *BOTH),
    "m10_switches_by_location": with_views(f"WITH {S} SELECT location_id, CAST(sum(context_switch_count) AS BIGINT) AS switches FROM ms GROUP BY location_id", *BOTH),
    "m10_switches_by_category": with_views(f"WITH {STC} SELECT category, CAST(sum(context_switch_count) AS BIGINT) AS switches FROM ms JOIN et USING (task_id) WHERE category IS NOT NULL GROUP BY category", *BOTH),
    "m12_heatmap": with_views("SELECT user_id, category, " + ", ".join(f"nullif(count(*) FILTER (b = {i}), 0) AS \"{i}_n\", CASE WHEN count(*) FILTER (b = {i}) >= 3 THEN round(count(*) FILTER (b = {i} AND status = 'completed') / count(*) FILTER (b = {i})::DOUBLE, 6) END AS \"{i}_done\", CASE WHEN count(*) FILTER (b = {i}) >= 3 THEN round(coalesce(count(*) FILTER (b = {i} AND status = 'forgotten') / nullif(count(*) FILTER (b = {i} AND status IN {_RES}), 0)::DOUBLE, 0), 6) END AS \"{i}_lost\"" for i in range(6)) + " FROM (SELECT *, hour(created_at) // 4 AS b FROM tasks) GROUP BY user_id, category", "tasks"),
    "m13_daily_rollup": with_views(f"WITH {S}, {ST}, {DAILY} SELECT * FROM dl", *BOTH),
    "m14_dimension_rollup": with_views(f"WITH {DIM} SELECT * FROM dm", "tasks"),
    "m15_series_summary": with_views(f"WITH {S}, {ST}, {DAILY}, nn AS (SELECT *, row_number() OVER (PARTITION BY user_id, metric_name ORDER BY period_start) - 1 AS i FROM dl) SELECT user_id, metric_name, count(*) AS n, round(avg(value), 6) AS mean, round(min(value), 6) AS low, round(max(value), 6) AS high, round(regr_slope(value, i), 8) AS slope FROM nn GROUP BY ALL", *BOTH),
    "k7_upsert": with_views(f"WITH {DIM} SELECT user_id, dimension, metric_name, CASE WHEN user_id % 3 = 0 THEN value + 1 ELSE value END AS value, CASE WHEN user_id % 3 = 0 THEN 2 ELSE 1 END AS computed_at FROM dm", "tasks"),
    "d1_friction": with_views(_friction(6, 3, 30, 100), *BOTH),
    "d6_friction_v2": with_views(_friction(8, 4, 45, 200), *BOTH),
    "d2_forget_risk": with_views(f"""WITH {BASE}, r AS (SELECT user_id, coalesce(count(*) FILTER (created_at >= TIMESTAMP '{AS_OF_EVENTS}' - INTERVAL 7 DAY AND status = 'forgotten') / nullif(count(*) FILTER (created_at >= TIMESTAMP '{AS_OF_EVENTS}' - INTERVAL 7 DAY AND status IN {_RES}), 0)::DOUBLE, 0) AS recent,
      coalesce(count(*) FILTER (status NOT IN {_RES} AND created_at + INTERVAL 29 DAY <= TIMESTAMP '{AS_OF_EVENTS}' + INTERVAL 1 DAY) / nullif(count(*) FILTER (status NOT IN {_RES}), 0)::DOUBLE, 0) AS near FROM st GROUP BY user_id)
      SELECT user_id, round(least(1, 0.4 * least(1, recent * 2) + 0.3 * least(1, {_PH} / 6) + 0.2 * least(1, {_PS} / 3) + 0.1 * near), 6) AS forget_risk FROM base JOIN r USING (user_id)""", *BOTH),
    **{f"d3_windowed_rates{suffix}": with_views(f"""WITH {S}, s AS (SELECT user_id, sum(focused_time_seconds + interruption_time_seconds) FILTER (session_start >= TIMESTAMP '{AS_OF_EVENTS}' - INTERVAL {h} HOUR) / 3600.0 AS h, sum(context_switch_count) FILTER (session_start >= TIMESTAMP '{AS_OF_EVENTS}' - INTERVAL {h} HOUR) AS sw, avg(resume_delay_seconds) FILTER (session_start >= TIMESTAMP '{AS_OF_EVENTS}' - INTERVAL 7 DAY) AS rs, count(resume_delay_seconds) FILTER (session_start >= TIMESTAMP '{AS_OF_EVENTS}' - INTERVAL 7 DAY) AS rn FROM ms GROUP BY user_id),
      i AS (SELECT user_id, count(*) AS n FROM ci WHERE start_time >= TIMESTAMP '{AS_OF_EVENTS}' - INTERVAL {h} HOUR GROUP BY user_id)
      SELECT user_id, round(coalesce(coalesce(sw, 0) / nullif(h, 0), 0), 6) AS switch_rate, round(coalesce(coalesce(n, 0) / nullif(h, 0), 0), 6) AS interruption_rate, round(rs, 6) AS recovery_s, rn AS recovery_n FROM s LEFT JOIN i USING (user_id)""", *BOTH) for suffix, h in (("", 72), ("_24h", 24))},
    **{f"d7_reliability{suffix}": with_views(f"WITH d AS (SELECT user_id, CAST({by} AS DATE) AS day, count(*) FILTER (status = 'completed') / count(*)::DOUBLE AS share FROM tasks WHERE {by} IS NOT NULL AND created_at >= TIMESTAMP '{AS_OF_TASKS}' - INTERVAL {days} DAY GROUP BY ALL), r AS (SELECT user_id, count(*) AS k, CASE WHEN count(*) < 2 THEN 0.5 WHEN avg(share) > 0 THEN least(greatest(1 - stddev_samp(share) / avg(share), 0), 1) ELSE 0 END AS r FROM d GROUP BY user_id) SELECT user_id, coalesce(k, 0) AS sample_days, round(coalesce(r, 0.5), 6) AS reliability FROM (SELECT DISTINCT user_id FROM tasks) LEFT JOIN r USING (user_id)", "tasks") for suffix, days, by in (("", 30, "completed_at"), ("_by_creation", 3650, "created_at"))},
    "d8_consistency": with_views("WITH p AS (SELECT user_id, category, location_id, count(*) AS n FROM tasks GROUP BY ALL), c AS (SELECT user_id, category, max(n) / sum(n) AS share FROM p GROUP BY ALL) SELECT user_id, round(avg(share), 6) AS consistency FROM c GROUP BY user_id", "tasks"),
    **{name: with_views(f"""WITH tk AS (SELECT user_id % 20 AS user_id, 'c' || location_id AS category, event_time AS created_at FROM task_events WHERE event_time >= TIMESTAMP '{AS_OF_EVENTS}' - INTERVAL 30 DAY), d AS (SELECT user_id, category, CAST(created_at AS DATE) AS day, count(*) AS n FROM tk GROUP BY ALL), a AS (SELECT user_id, category, min(day) AS a, max(day) AS b, count(*) AS days FROM d GROUP BY ALL), s AS (SELECT user_id, category, days, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM a),
      f AS (SELECT s.user_id, s.category, days, coalesce(n, 0) AS n, lag(coalesce(n, 0), 7) OVER (PARTITION BY s.user_id, s.category ORDER BY s.day) AS back FROM s LEFT JOIN d USING (user_id, category, day)), r AS (SELECT user_id, category, round(CASE WHEN max(days) >= 14 THEN greatest(0, coalesce(CASE WHEN isnan(corr(n, back)) THEN 0 ELSE corr(n, back) END, 0)) ELSE 0 END, 6) AS repetition FROM f GROUP BY ALL) {tail}""", "task_events") for name, tail in (("d9_category_repetition", "SELECT * FROM r"), ("d9_repetition", "SELECT user_id, count(*) AS categories, round(avg(repetition), 6) AS repetition_strength FROM r GROUP BY user_id"))},
    "d10_time_lost": with_views(f"WITH {BASE} SELECT user_id, round(interruption_s / 3600.0, 6) AS interruption_hours, round(interruption_s / 3600.0 + switches * 5 / 60.0, 6) AS hours_lost FROM base", *BOTH),
    **{f"m_tasks_by_{n}": with_views(f"SELECT {k} AS bucket, {_TM} FROM tasks GROUP BY bucket", "tasks") for n, (_, k) in _KEYS.items()},
    **{f"m_interruptions_by_{n}": with_views(f"WITH {_CLEAN_I} SELECT {k} AS bucket, {_IM} FROM ci GROUP BY bucket", "interruptions") for n, (_, k) in _IKEYS.items()},
}
