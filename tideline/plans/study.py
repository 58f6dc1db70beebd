"""Queries over statistics, data quality and insights, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import insights, metrics, sessions, stats
from ..operators.vocabulary import TERMINAL
from ..sources.tables import stored
from .views import AS_OF_EVENTS, AS_OF_TASKS, view, with_views
from .work import BASE, LOST, STC, S, _interruptions, _sessions, _status, _tasks_of_events

_T = lambda s, sf: view(s, sf, "tasks")
_O = lambda s, sf: s.read.parquet(f"{sf}/orders.parquet")
_L = lambda s, sf: s.read.parquet(f"{sf}/lineitem.parquet")
MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
STEPPED = ["l_quantity", "l_discount", "l_tax"]  # few distinct values, so that SQL can compare all pairs of them
SESSION_MEASURES = ["focused_time_seconds", "interruption_time_seconds", "context_switch_count", "interruption_count"]


def _days(s, sf):
    return _T(s, sf).groupBy("category", F.to_date("created_at").alias("day")).agg(F.count("*").alias("n"))


def _grouped(s, sf, x=None, i=None):
    t = _tasks_of_events(s, sf)
    of = t.select("task_id", "category").where("category IS NOT NULL")
    x, i = _sessions(s, sf) if x is None else x, _interruptions(s, sf) if i is None else i
    return insights.category_friction(t.where("category IS NOT NULL"), x.join(of, "task_id"), i.join(of, "task_id"))


def _all(s, sf):
    """The ten insights; sessions and interruptions are reconstructed and written once."""
    i = stored(_interruptions(s, sf), "interruptions")
    x = stored(sessions.measured_sessions(sessions.lifecycle_sessions(view(s, sf, "task_events"), AS_OF_EVENTS), i), "sessions")
    t = stored(_T(s, sf), "tasks")
    base = metrics.base_by_user(_status(s, sf), i, x)
    return insights.all_insights(insights.forgetting_timing(t), insights.context_forgetting(t), _grouped(s, sf, x, i), insights.switch_timing(x), insights.interruption_cost(base), insights.recurring_delay(t), insights.context_association(t), insights.friction_timing(x), insights.behaviour_trend(t), insights.attention_insight(t, AS_OF_TASKS))


def _flat(op):
    return lambda s, sf: op(s, sf).select("user_id", "insight", "risk", "subjects", F.explode("evidence").alias("field", "value")).withColumn("subjects", F.array_join(F.col("subjects")[F.col("field")], ", "))


def _pairs_sql(cols, table):
    c = [f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM {table}" for i, a in enumerate(cols) for b in cols[i + 1 :]]
    return " UNION ALL ".join(c)


def _tau_sql(cols, table):
    """Kendall's tau-b over all pairs of distinct values, weighted by their rows."""
    one = """(WITH c AS (SELECT {a} AS x, {b} AS y, CAST(count(*) AS DOUBLE) AS n FROM {t} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY ALL)
      SELECT '{a}' AS a, '{b}' AS b, round(sum(p.n * q.n * sign(p.x - q.x) * sign(p.y - q.y)) / sqrt(sum(p.n * q.n) FILTER (p.x <> q.x)) / sqrt(sum(p.n * q.n) FILTER (p.y <> q.y)), 6) AS r FROM c AS p, c AS q)"""
    return " UNION ALL ".join(one.format(a=a, b=b, t=table) for i, a in enumerate(cols) for b in cols[i + 1 :])


def _ev(name, src, risk, of=None, **fields):
    subjects = lambda k: f"coalesce({of[k]}, '')" if k in (of or {}) else "CAST(NULL AS VARCHAR)"
    return " UNION ALL ".join(f"SELECT user_id, '{name}' AS insight, {risk} AS risk, {subjects(k)} AS subjects, '{k}' AS field, round(CAST({v} AS DOUBLE), 6) AS value FROM {src}" for k, v in fields.items())


def _lv(high, medium):
    return f"CASE WHEN {high} THEN 'HIGH' WHEN {medium} THEN 'MEDIUM' ELSE 'LOW' END"


_OWN = f"own AS (SELECT user_id, {LOST} AS own FROM tasks GROUP BY user_id)"


_NAMES = "array_to_string(list_transform(list_sort(list(b)), lambda x: {}), ', ')"
_DAY = f"{insights.DAYS}[x]"


def _over(name, key, times, col, of="x"):
    return f"{name} AS (SELECT user_id, count(*) AS {col}, {_NAMES.format(of)} AS {col}_of FROM (SELECT user_id, {key} AS b, {LOST} AS rate FROM tasks GROUP BY ALL) JOIN own USING (user_id) WHERE rate > {times} * own GROUP BY user_id)"


def _peak(name, key, value):
    return f"{name} AS (SELECT user_id, max(v) AS p, arg_max(k, (v, -k)) AS at, avg(v) AS m FROM (SELECT user_id, {key} AS k, {value} AS v FROM ms GROUP BY ALL) GROUP BY user_id)"


def _late(name, key):
    return f"{name} AS (SELECT user_id, count(*) AS o, {_NAMES.format('x')} AS names FROM (SELECT user_id, {key} AS b, avg(late) AS rate FROM l1 GROUP BY ALL) JOIN l2 USING (user_id) WHERE rate > 1.3 * own GROUP BY user_id)"


_FV = "coalesce((2 * sum(context_switch_count) + sum(interruption_count)) / nullif(sum(focused_time_seconds + interruption_time_seconds) / 3600.0, 0), 0)"
_PRIMARY = "pl AS (SELECT user_id, category, arg_max(location_id, (n, -location_id)) AS location_id, max(n) / sum(n) AS share FROM (SELECT user_id, category, location_id, count(*) AS n FROM tasks WHERE location_id IS NOT NULL GROUP BY ALL) GROUP BY ALL)"
_LATE = f"(epoch_us(deadline_at) - epoch_us(TIMESTAMP '{AS_OF_TASKS}')) / 8.64e10"
_ATTENTION = f"""c AS (SELECT user_id, category, {LOST} AS cr FROM tasks GROUP BY ALL), r AS (SELECT user_id, task_id, round(CASE WHEN priority >= 4 THEN 0.3 WHEN priority = 3 THEN 0.15 ELSE 0 END + CASE WHEN {_LATE} < 1 THEN 0.4 WHEN {_LATE} < 3 THEN 0.2 ELSE 0 END + CASE WHEN cr > 0.3 THEN 0.2 ELSE 0 END, 4) AS risk_score FROM tasks JOIN c USING (user_id, category) WHERE status NOT IN ('completed', 'forgotten', 'cancelled')),
      att AS (SELECT * FROM (SELECT user_id, task_id, risk_score, CAST(row_number() OVER (PARTITION BY user_id ORDER BY risk_score DESC, task_id) AS INT) AS position FROM r WHERE risk_score > 0.5) WHERE position <= 5)"""
PARTS = {
    "i1_forgetting_timing": (f"{_OWN}, {_over('o1', 'isodow(created_at)', 1.5, 'days', _DAY)}, {_over('o2', 'hour(created_at)', 1.5, 'hours')}, i1 AS (SELECT user_id, own, coalesce(days, 0) AS days, coalesce(hours, 0) AS hours, days_of, hours_of FROM own LEFT JOIN o1 USING (user_id) LEFT JOIN o2 USING (user_id))", _ev("forgetting_timing", "i1", _lv("days > 2", "days >= 1"), {"weekdays": "days_of", "hours": "hours_of"}, overall="own", weekdays="days", hours="hours"), ["tasks"]),
    "i2_context_forgetting": (f"{_OWN}, {_over('o3', 'category', 1.3, 'nc')}, {_over('o4', 'location_id', 1.3, 'nl')}, i2 AS (SELECT user_id, own, coalesce(nc, 0) AS nc, coalesce(nl, 0) AS nl, nc_of, nl_of FROM own LEFT JOIN o3 USING (user_id) LEFT JOIN o4 USING (user_id))", _ev("context_forgetting", "i2", _lv("nc > 1", "nc = 1"), {"categories": "nc_of", "locations": "nl_of"}, overall="own", categories="nc", locations="nl"), ["tasks"]),
    "i3_category_friction": (f"{STC}, g1 AS (SELECT ms.user_id, category AS c, sum(context_switch_count) AS sw, count(*) AS n, sum(focused_time_seconds + interruption_time_seconds) / 3600.0 AS h FROM ms JOIN et USING (task_id) WHERE category IS NOT NULL GROUP BY ALL), g2 AS (SELECT ci.user_id, category AS c, count(*) AS i FROM ci JOIN et USING (task_id) WHERE category IS NOT NULL GROUP BY ALL), g3 AS (SELECT user_id, category AS c, {LOST} AS f FROM et WHERE category IS NOT NULL GROUP BY ALL), i3 AS (SELECT user_id, avg(v) AS m, max(v) AS p, arg_min(c, (-v, c)) AS w FROM (SELECT user_id, c, f * 100 + coalesce(coalesce(i, 0) / nullif(h, 0), 0) * 10 + sw / n * 20 AS v FROM g1 JOIN g3 USING (user_id, c) LEFT JOIN g2 USING (user_id, c)) GROUP BY user_id)", _ev("category_friction", "i3", "CASE WHEN p > 1.5 * m THEN 'HIGH' ELSE 'MEDIUM' END", {"peak": "w"}, average="m", peak="p"), ["task_events", "interruptions"]),
    "i4_switch_timing": (f"{S}, {_peak('h1', 'isodow(session_start) - 1', 'avg(context_switch_count)')}, {_peak('h2', 'hour(session_start)', 'avg(context_switch_count)')}, h3 AS (SELECT user_id, avg(context_switch_count) AS own FROM ms GROUP BY ALL), i4 AS (SELECT user_id, own, h1.p AS dp, h1.at AS da, h2.p AS hp, h2.at AS ha FROM h3 JOIN h1 USING (user_id) JOIN h2 USING (user_id))", _ev("switch_timing", "i4", "CASE WHEN dp > 2 * own THEN 'HIGH' ELSE 'MEDIUM' END", average="own", weekday="da", weekday_peak="dp", hour="ha", hour_peak="hp"), ["task_events", "interruptions"]),
    "i5_interruption_cost": (f"{BASE}, i5 AS (SELECT user_id, interruption_s / 3600.0 + switches * 5 / 60.0 AS h, active_s / 3600.0 AS a FROM base)", _ev("interruption_cost", "i5", _lv("h > 2", "h > 1"), hours_lost="h", share="coalesce(h / nullif(a, 0), 0)"), ["task_events", "interruptions"]),
    "i6_recurring_delay": (f"l1 AS (SELECT user_id, priority, category, CASE WHEN completed_at > deadline_at THEN 1 ELSE 0 END AS late FROM tasks WHERE status = 'completed' AND deadline_at IS NOT NULL), l2 AS (SELECT user_id, avg(late) AS own, count(*) AS n FROM l1 GROUP BY user_id), {_late('l3', 'priority')}, {_late('l4', 'category')}, i6 AS (SELECT user_id, own, n, coalesce(l3.o, 0) AS o, coalesce(l4.o, 0) AS oc, l3.names AS po, l4.names AS co FROM l2 LEFT JOIN l3 USING (user_id) LEFT JOIN l4 USING (user_id))", _ev("recurring_delay", "i6", _lv("oc > 1", "oc = 1"), {"categories": "co", "priorities": "po"}, late_share="own", categories="oc", priorities="o", tasks="n"), ["tasks"]),
    "i7_context_association": (f"{_PRIMARY}, i7 AS (SELECT user_id, min(share) AS a, max(share) AS b, avg(share) AS m, arg_min(location_id, (-share, category)) AS l, count(*) AS c FROM pl GROUP BY user_id)", _ev("context_association", "i7", "CASE WHEN a < 0.3 THEN 'MEDIUM' ELSE 'LOW' END", weakest="a", strongest="b", strongest_location="l", average="m", categories="c"), ["tasks"]),
    "i8_friction_timing": (f"{S}, {_peak('w1', 'isodow(session_start) - 1', _FV)}, {_peak('w2', 'hour(session_start)', _FV)}, i8 AS (SELECT user_id, w1.m AS m, w1.p AS dp, w1.at AS da, w2.p AS hp, w2.at AS ha FROM w1 JOIN w2 USING (user_id))", _ev("friction_timing", "i8", "CASE WHEN dp > 2 * m THEN 'HIGH' ELSE 'MEDIUM' END", average="m", weekday="da", weekday_peak="dp", hour="ha", hour_peak="hp"), ["task_events", "interruptions"]),
    "i9_behaviour_trend": ("b1 AS (SELECT user_id, CAST(created_at AS DATE) AS day, avg(CASE WHEN status = 'forgotten' THEN 1.0 ELSE 0.0 END) AS rate FROM tasks WHERE status IN ('completed', 'forgotten', 'cancelled') GROUP BY ALL), i9 AS (SELECT user_id, count(*) AS days, regr_slope(rate, i) AS slope FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day) - 1 AS i FROM b1) GROUP BY user_id HAVING count(*) >= 7)", _ev("behaviour_trend", "i9", _lv("slope > 0.005", "slope > 0.001"), slope="slope", days="days"), ["tasks"]),
    "i10_attention_insight": (f"{_ATTENTION}, i10 AS (SELECT user_id, active, coalesce(n, 0) AS n, coalesce(top, 0) AS top FROM (SELECT user_id, count(*) AS active FROM tasks WHERE status NOT IN ('completed', 'forgotten', 'cancelled') GROUP BY user_id) LEFT JOIN (SELECT user_id, count(*) AS n, max(risk_score) AS top FROM att GROUP BY user_id) USING (user_id))", _ev("proactive_attention", "i10", _lv("n > 2", "n >= 1"), active_tasks="active", tasks="n", top_score="top"), ["tasks"]),
}
_ALL_SQL = " UNION ALL ".join(f"SELECT * FROM (WITH {c} {q})" for c, q, _ in PARTS.values())

QUERIES = {
    "s1_distribution": lambda s, sf: stats.distribution(_O(s, sf), "o_totalprice", "o_orderpriority", "o_orderstatus"),
    "s2_correlations": lambda s, sf: stats.correlations(_L(s, sf), MEASURES),
    "s2_kendall": lambda s, sf: stats.kendall(_L(s, sf), STEPPED),
    "s2_rank_correlations": lambda s, sf: stats.correlations(_L(s, sf), MEASURES[2:] + ["l_quantity"], ranked=True),
    "s3_trend": lambda s, sf: stats.trend(_days(s, sf), "day", "n", "category"),
    "s4_compare": lambda s, sf: stats.compare(_O(s, sf), "o_totalprice", F.col("o_orderstatus") == "F"),
    "s5_percentile_rank": lambda s, sf: stats.percentile_rank(_O(s, sf).select("o_orderkey", "o_orderpriority", "o_totalprice"), "o_totalprice", "o_orderpriority"),
    "s6_moving_averages": lambda s, sf: stats.moving_averages(_days(s, sf), "day", "n", "category"),
    "s7_outliers_iqr": lambda s, sf: stats.outliers(_T(s, sf).groupBy("user_id").agg(F.count("*").alias("n")), "n"),
    "s7_outliers_z": lambda s, sf: stats.outliers(_L(s, sf).select("l_orderkey", "l_linenumber", "l_extendedprice"), "l_extendedprice", "zscore"),
    "s8_cramers_v": lambda s, sf: stats.cramers_v(_T(s, sf), "category", "status"),
    "s10_session_correlations": lambda s, sf: stats.correlations(_sessions(s, sf), SESSION_MEASURES),
    "q2_null_rates": lambda s, sf: stats.null_rates(_T(s, sf), ["started_at", "completed_at", "deadline_at", "category"]),
    "q3_sequences": lambda s, sf: view(s, sf, "task_events").groupBy("task_id").agg(F.count_if(F.col("event_type").isin("created", "started", "resumed")).alias("o"), F.count_if(F.col("event_type").isin(TERMINAL)).alias("t")).agg(F.round(F.avg("o"), 6).alias("avg_open"), F.round(F.avg("t"), 6).alias("avg_terminal"), F.count_if((F.col("o") > 0) & (F.col("t") == 0)).alias("never_ended")),
    "q5_timestamp_range": lambda s, sf: view(s, sf, "task_events").agg(F.min("event_time").alias("first"), F.max("event_time").alias("last"), F.datediff(F.max("event_time"), F.min("event_time")).alias("days")),
    "q6_class_balance": lambda s, sf: _T(s, sf).agg(F.count("*").alias("rows"), F.count_if(F.col("status") == "forgotten").alias("positive")).withColumn("share", F.round(F.try_divide("positive", "rows"), 6)).withColumn("note", F.when(F.col("share").between(0.1, 0.4), "ok").otherwise("unbalanced")),
    "q9_fingerprint": lambda s, sf: stats.fingerprint(_O(s, sf)),
    "l6_profile": lambda s, sf: stats.profile(_L(s, sf), MEASURES),
    "i10_attention": lambda s, sf: insights.attention(_T(s, sf), AS_OF_TASKS),
    "i3_category_friction": _flat(_grouped),
    "i1_forgetting_timing": _flat(lambda s, sf: insights.forgetting_timing(_T(s, sf))),
    "i2_context_forgetting": _flat(lambda s, sf: insights.context_forgetting(_T(s, sf))),
    "i4_switch_timing": _flat(lambda s, sf: insights.switch_timing(_sessions(s, sf))),
    "i5_interruption_cost": _flat(lambda s, sf: insights.interruption_cost(metrics.base_by_user(_status(s, sf), _interruptions(s, sf), _sessions(s, sf)))),
    "i6_recurring_delay": _flat(lambda s, sf: insights.recurring_delay(_T(s, sf))),
    "i7_context_association": _flat(lambda s, sf: insights.context_association(_T(s, sf))),
    "i8_friction_timing": _flat(lambda s, sf: insights.friction_timing(_sessions(s, sf))),
    "i9_behaviour_trend": _flat(lambda s, sf: insights.behaviour_trend(_T(s, sf))),
    "i10_attention_insight": _flat(lambda s, sf: insights.attention_insight(_T(s, sf), AS_OF_TASKS)),
    "i7_primary_locations": lambda s, sf: insights.primary_locations(_T(s, sf)).withColumn("share", F.round("share", 6)),
    "i11_all_insights": _flat(_all),
    "i12_story": lambda s, sf: insights.story(_all(s, sf)),
}
SQL = {
    "s1_distribution": "SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(avg(o_totalprice), 6) AS mean, round(quantile_cont(o_totalprice, 0.5), 6) AS median, round(stddev_samp(o_totalprice), 6) AS std, min(o_totalprice) AS low, max(o_totalprice) AS high, round(quantile_cont(o_totalprice, 0.25), 6) AS q25, round(quantile_cont(o_totalprice, 0.75), 6) AS q75, round(quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25), 6) AS iqr, CASE WHEN count(*) >= 30 THEN 'HIGH' WHEN count(*) >= 10 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM orders GROUP BY ALL",
    "s2_correlations": _pairs_sql(MEASURES, "lineitem"),
    "s2_kendall": _tau_sql(STEPPED, "lineitem"),
    "s2_rank_correlations": "WITH r AS (SELECT " + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in MEASURES[2:] + ["l_quantity"]) + " FROM lineitem) " + _pairs_sql(MEASURES[2:] + ["l_quantity"], "r"),
    "s3_trend": with_views("""WITH d AS (SELECT category, CAST(created_at AS DATE) AS day, count(*) AS n FROM tasks GROUP BY ALL), x AS (SELECT category, n, day - min(day) OVER (PARTITION BY category) AS t FROM d),
      a AS (SELECT category, count(*) AS n, CASE WHEN count(*) >= 5 THEN round(regr_slope(n, t), 6) END AS slope, CASE WHEN count(*) >= 5 THEN round(regr_intercept(n, t), 6) END AS intercept, CASE WHEN count(*) >= 5 THEN round(regr_r2(n, t), 6) END AS r2 FROM x GROUP BY category)
      SELECT *, CASE WHEN slope IS NULL THEN 'insufficient' WHEN abs(slope) < 0.001 THEN 'stable' WHEN slope > 0 THEN 'increasing' ELSE 'decreasing' END AS direction, CASE WHEN n >= 30 AND r2 > 0.5 THEN 'HIGH' WHEN n >= 10 AND r2 > 0.3 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM a""", "tasks"),
    "s4_compare": "WITH x AS (SELECT CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS a, CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END AS b FROM orders), c AS (SELECT count(a) AS n1, count(b) AS n2, avg(a) - avg(b) AS m, quantile_cont(a, 0.5) - quantile_cont(b, 0.5) AS d, sqrt((var_samp(a) + var_samp(b)) / 2) AS p FROM x) SELECT n1, n2, round(m, 6) AS mean_difference, round(d, 6) AS median_difference, round(m / p, 6) AS cohens_d, CASE WHEN abs(m / p) < 0.2 THEN 'negligible' WHEN abs(m / p) < 0.5 THEN 'small' WHEN abs(m / p) < 0.8 THEN 'medium' ELSE 'large' END AS effect FROM c",
    "s5_percentile_rank": "WITH r AS (SELECT o_orderkey, o_orderpriority, o_totalprice, (rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) - 1) / (count(*) OVER (PARTITION BY o_orderpriority))::DOUBLE * 100 AS x FROM orders) SELECT o_orderkey, o_orderpriority, o_totalprice, round(x, 6) AS rank, CASE WHEN x >= 75 THEN 'top' WHEN x >= 50 THEN 'above_average' WHEN x >= 25 THEN 'below_average' ELSE 'bottom' END AS band FROM r",
    "s6_moving_averages": with_views("WITH d AS (SELECT category, CAST(created_at AS DATE) AS day, count(*) AS n FROM tasks GROUP BY ALL) SELECT category, day, n, " + ", ".join(f"CASE WHEN count(*) OVER (PARTITION BY category) >= {k} THEN round(avg(n) OVER (PARTITION BY category ORDER BY day ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW), 6) END AS ma_{k}" for k in (7, 14, 30)) + " FROM d", "tasks"),
    "s7_outliers_iqr": with_views("WITH d AS (SELECT user_id, count(*) AS n FROM tasks GROUP BY user_id), b AS (SELECT quantile_cont(n, 0.25) AS a, quantile_cont(n, 0.75) AS z FROM d) SELECT user_id, n FROM d, b WHERE n < a - 1.5 * (z - a) OR n > z + 1.5 * (z - a)", "tasks"),
    "s7_outliers_z": "WITH b AS (SELECT avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS s FROM lineitem) SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem, b WHERE l_extendedprice < m - 1.5 * s OR l_extendedprice > m + 1.5 * s",
    "s8_cramers_v": with_views("""WITH g AS (SELECT a.category, b.status, (SELECT count(*) FROM tasks t WHERE t.category = a.category AND t.status = b.status) AS o FROM (SELECT DISTINCT category FROM tasks) a, (SELECT DISTINCT status FROM tasks) b),
      e AS (SELECT o, sum(o) OVER (PARTITION BY category) * sum(o) OVER (PARTITION BY status) / sum(o) OVER () AS e, sum(o) OVER () AS n FROM g), c AS (SELECT sum((o - e) * (o - e) / e) AS chi2, any_value(n) AS n, (SELECT least(count(DISTINCT category), count(DISTINCT status)) - 1 FROM tasks) AS k FROM e)
      SELECT round(chi2, 6) AS chi2, round(sqrt(chi2 / (n * k)), 6) AS v, CASE WHEN sqrt(chi2 / (n * k)) < 0.1 THEN 'negligible' WHEN sqrt(chi2 / (n * k)) < 0.3 THEN 'weak' WHEN sqrt(chi2 / (n * k)) < 0.5 THEN 'moderate' ELSE 'strong' END AS association FROM c""", "tasks"),
    "s10_session_correlations": with_views(f"WITH {S} {_pairs_sql(SESSION_MEASURES, 'ms')}", "task_events", "interruptions"),
    "q2_null_rates": with_views(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS rows, count(*) - count({c}) AS nulls, round((count(*) - count({c})) / count(*)::DOUBLE, 6) AS rate, CASE WHEN round((count(*) - count({c})) / count(*)::DOUBLE, 6) > 0.2 THEN 'high' WHEN round((count(*) - count({c})) / count(*)::DOUBLE, 6) > 0.05 THEN 'medium' WHEN round((count(*) - count({c})) / count(*)::DOUBLE, 6) > 0.001 THEN 'low' ELSE 'ok' END AS band FROM tasks" for c in ("started_at", "completed_at", "deadline_at", "category")), "tasks"),
    "q3_sequences": with_views("WITH g AS (SELECT task_id, count(*) FILTER (event_type IN ('created', 'started', 'resumed')) AS o, count(*) FILTER (event_type IN ('completed', 'forgotten', 'cancelled')) AS t FROM task_events GROUP BY task_id) SELECT round(avg(o), 6) AS avg_open, round(avg(t), 6) AS avg_terminal, count(*) FILTER (o > 0 AND t = 0) AS never_ended FROM g", "task_events"),
    "q5_timestamp_range": with_views("SELECT min(event_time) AS first, max(event_time) AS last, CAST(CAST(max(event_time) AS DATE) - CAST(min(event_time) AS DATE) AS INT) AS days FROM task_events", "task_events"),
    "q6_class_balance": with_views("SELECT count(*) AS rows, count(*) FILTER (status = 'forgotten') AS positive, round(count(*) FILTER (status = 'forgotten') / count(*)::DOUBLE, 6) AS share, CASE WHEN count(*) FILTER (status = 'forgotten') / count(*)::DOUBLE BETWEEN 0.1 AND 0.4 THEN 'ok' ELSE 'unbalanced' END AS note FROM tasks", "tasks"),
    "l6_profile": " UNION ALL ".join(f"SELECT '{c}' AS column_name, round((count(*) - count({c})) / count(*)::DOUBLE, 6) AS null_rate, min({c}) AS low, max({c}) AS high, round(avg({c}), 6) AS mean FROM lineitem" for c in MEASURES),
    "i10_attention": with_views(f"WITH {_ATTENTION} SELECT * FROM att", "tasks"),
    "i7_primary_locations": with_views(f"WITH {_PRIMARY} SELECT user_id, category, location_id, round(share, 6) AS share FROM pl", "tasks"),
    **{k: with_views(f"WITH {c} {q}", *v) for k, (c, q, v) in PARTS.items()},
    "i11_all_insights": with_views(_ALL_SQL, "tasks", "task_events", "interruptions"),
    "i12_story": with_views(f"""WITH o AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{k}', '{v}')" for i, (k, v) in enumerate(insights.ADVICE.items()))}) AS t(o, insight, advice)), a AS (SELECT user_id, insight, risk, string_agg(subjects, ', ' ORDER BY field) FILTER (subjects <> '') AS names FROM ({_ALL_SQL}) GROUP BY ALL), l AS (SELECT * FROM a JOIN o USING (insight))
      SELECT user_id, count(*) AS insights, count(*) FILTER (risk = 'HIGH') AS high, count(*) FILTER (risk = 'MEDIUM') AS medium, CASE WHEN count(*) FILTER (risk = 'HIGH') > 0 THEN count(*) FILTER (risk = 'HIGH') || ' patterns of high risk need attention.' ELSE 'No pattern of high risk.' END AS narrative,
      array_to_string(list(concat_ws(': ', insight, lower(risk), names) ORDER BY o)[1:3], '; ') AS findings, coalesce(string_agg(concat_ws(': ', insight, names), '; ' ORDER BY o) FILTER (risk = 'HIGH'), '') AS risks, array_to_string(list(advice ORDER BY o)[1:3], '; ') AS recommendations FROM l GROUP BY user_id""", "tasks", "task_events", "interruptions"),
}
