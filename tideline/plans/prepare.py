"""Queries over validation, cleaning and enrichment, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean, enrich, stats, validate
from ..operators.vocabulary import CATEGORY_ALIASES, EVENT_TYPES, INTERRUPTION_TYPES
from ..sources import tables
from .views import AS_OF_EVENTS, view, with_views

ALIASES = {"promo": "promotion", "economy": "saver", "standard": "plain"}  # for the part types of the tables
_in = lambda v: ", ".join(f"'{x}'" for x in v)


def _dirty(spark, sf):
    return view(spark, sf, "dirty_events")


def issues(spark, sf):
    i, t = view(spark, sf, "interruptions"), view(spark, sf, "tasks")
    return validate.validate_all(validate.validate_events(_dirty(spark, sf), AS_OF_EVENTS), validate.validate_interruptions(i, AS_OF_EVENTS), validate.validate_tasks(t))


def _stamped(spark, sf):
    """Events with their times as text, every 50th of which is none."""
    e = view(spark, sf, "task_events")
    return e.select("id", F.when(F.col("id") % 50 == 0, "not a time").when(F.col("id") % 51 != 0, F.date_format("event_time", "yyyy-MM-dd HH:mm:ss")).alias("event_time"))


def _odd_tasks(spark, sf):
    """Tasks with priorities out of range."""
    return view(spark, sf, "tasks").withColumn("priority", F.when(F.col("task_id") % 10 == 0, 9).when(F.col("task_id") % 10 == 1, 0).otherwise(F.col("priority")))


_SPELLINGS = [*CATEGORY_ALIASES, "work", "other"]


def aliased(spark, sf):
    """Category names as data may spell them, dealt to the parts."""
    spelled = F.concat(F.lit(" "), F.upper(F.element_at(F.array(*map(F.lit, _SPELLINGS)), (F.col("p_partkey") % len(_SPELLINGS) + 1).cast("int"))))
    return clean.normalise_category(spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", spelled.alias("category")), CATEGORY_ALIASES)


def stored_rate(spark, sf):
    from pyspark.sql import Window

    t = view(spark, sf, "tasks")
    w = Window.partitionBy("user_id").orderBy("created_at", "task_id").rowsBetween(Window.unboundedPreceding, -1)
    stored = F.avg((F.col("status") == "forgotten").cast("double")).over(w)
    return validate.leakage_audit(t.withColumn("stored", F.when(F.col("task_id") % 50 == 0, F.coalesce(stored, F.lit(0.0)) + 0.1).otherwise(stored)), "stored")


def event_time_shape(spark, sf):
    d = enrich.enrich_events(view(spark, sf, "task_events"))
    return d.select("id", "hour", "weekday_name", "weekday", "is_late_night", "inter_event_gap_s", "session_index")


def model_input_issues(spark, sf):
    t = view(spark, sf, "tasks")
    d = t.select("task_id", "category", "priority", "location_id", F.weekday("created_at").alias("weekday"), (F.hour("created_at") + F.when(F.col("task_id") % 97 == 0, 24).otherwise(0)).alias("hour"), (F.col("task_id") % 101 - 1).alias("n_prior"), (F.col("task_id") % 13 / 11.0).alias("done_rate"))
    return validate.validate_model_input(d, ["general", "PROMO"], [0, 1, 2, 3])


_ISSUES_SQL = f"""
WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id, task_id, event_type, event_time ORDER BY id) AS again,
  max(CASE WHEN lower(event_type) IN ('completed', 'forgotten', 'cancelled') THEN 1 ELSE 0 END) OVER (PARTITION BY task_id ORDER BY event_time NULLS FIRST, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ended FROM dirty_events)
SELECT 'events' AS stage, 'error' AS severity, 'missing_required_field:event_time' AS rule, id AS row_key FROM e WHERE event_time IS NULL
UNION ALL SELECT 'events', 'error', 'invalid_event_type', id FROM e WHERE lower(event_type) NOT IN ({_in(EVENT_TYPES)})
UNION ALL SELECT 'events', 'warning', 'future_timestamp', id FROM e WHERE event_time > TIMESTAMP '{AS_OF_EVENTS}'
UNION ALL SELECT 'events', 'error', 'prehistoric_timestamp', id FROM e WHERE event_time < TIMESTAMP '2000-01-01'
UNION ALL SELECT 'events', 'warning', 'duplicate_event', id FROM e WHERE again > 1
UNION ALL SELECT 'events', 'error', 'impossible_sequence', id FROM e WHERE ended = 1 AND lower(event_type) IN ('created', 'started')
UNION ALL SELECT 'interruptions', 'error', 'invalid_interruption_type', id FROM interruptions WHERE interruption_type NOT IN ({_in(INTERRUPTION_TYPES)})
UNION ALL SELECT 'interruptions', 'error', 'end_before_start', id FROM interruptions WHERE end_time < start_time
UNION ALL SELECT 'interruptions', 'error', 'negative_duration', id FROM interruptions WHERE duration_seconds < 0
UNION ALL SELECT 'interruptions', 'warning', 'future_timestamp', id FROM interruptions WHERE start_time > TIMESTAMP '{AS_OF_EVENTS}'
UNION ALL SELECT 'tasks', 'error', 'invalid_priority', task_id FROM tasks WHERE priority NOT BETWEEN 1 AND 5
UNION ALL SELECT 'tasks', 'error', 'started_before_created', task_id FROM tasks WHERE started_at < created_at
UNION ALL SELECT 'tasks', 'error', 'completed_before_started', task_id FROM tasks WHERE completed_at < started_at
"""
_NEARBY = "SELECT t.user_id, t.task_id, CAST(count(i.id) AS BIGINT) AS n_nearby FROM (SELECT user_id, id AS task_id, event_time AS created_at FROM task_events WHERE event_type = 'created') t LEFT JOIN interruptions i ON i.user_id = t.user_id AND i.start_time BETWEEN t.created_at AND t.created_at + INTERVAL 30 MINUTE GROUP BY ALL"
_ALIAS_SQL = "CASE lower(category) " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in ALIASES.items()) + " ELSE lower(category) END"
_CLEAN_I = """c AS (SELECT * REPLACE (coalesce(duration_seconds, CAST(floor(greatest(0, (epoch_us(end_time) - epoch_us(start_time)) / 1e6)) AS BIGINT)) AS duration_seconds)
  FROM interruptions QUALIFY row_number() OVER (PARTITION BY user_id, task_id, interruption_type, start_time ORDER BY id) = 1),
 ci AS (SELECT * REPLACE (coalesce(end_time, make_timestamp(epoch_us(start_time) + duration_seconds * 1000000)) AS end_time), coalesce(duration_seconds > 43200, false) AS is_anomaly FROM c)"""

QUERIES = {
    "v_issues": issues,
    "v_issue_summary": lambda s, sf: validate.summary(issues(s, sf)),
    "v13_model_input": model_input_issues,
    "v14_leakage_audit": stored_rate,
    "c_events": lambda s, sf: clean.clean_events(_dirty(s, sf)),
    "c_interruptions": lambda s, sf: clean.clean_interruptions(view(s, sf, "interruptions")),
    "c_tasks": lambda s, sf: clean.clean_tasks(view(s, sf, "tasks"), ALIASES).select("task_id", "status", "category", "priority", "is_anomaly"),
    "c12_written_and_counted": lambda s, sf: tables.write_cleaned(_dirty(s, sf), view(s, sf, "interruptions"), _odd_tasks(s, sf), ALIASES, tables.scratch_path(s, "cleaned")),
    "c12_cleaning_report": lambda s, sf: clean.cleaning_report(_dirty(s, sf), view(s, sf, "interruptions"), _odd_tasks(s, sf), ALIASES),
    "c1_to_utc": lambda s, sf: clean.to_utc(_stamped(s, sf), ["event_time"]),
    "c9_category_aliases": aliased,
    "c10_clamped_tasks": lambda s, sf: clean.clean_tasks(_odd_tasks(s, sf), ALIASES).select("task_id", "priority", "priority_clamped"),
    "v3_invalid_timestamps": lambda s, sf: validate.timestamp_issues(_stamped(s, sf), "event_time"),
    "v12_verdict": lambda s, sf: validate.verdict(issues(s, sf)),
    "q1_table_counts": lambda s, sf: stats.table_counts({n: view(s, sf, n) for n in ("task_events", "interruptions", "tasks", "locations")}),
    "c13_tag_category": lambda s, sf: s.read.parquet(f"{sf}/part.parquet").select("p_partkey", clean.tag_category(F.col("p_name"), {"part 1": "first"}, [("9", "nine"), ("5", "five"), ("1", "one")], "other").alias("tag")),
    "t_events": event_time_shape,
    "t_tasks": lambda s, sf: enrich.enrich_tasks(view(s, sf, "tasks"), view(s, sf, "locations")).select("task_id", "task_location_pair", "start_delay_h", "duration_h", "deadline_h", "is_late_night_start", "is_repeated_context"),
    "t8_interruptions": lambda s, sf: enrich.enrich_interruptions(clean.clean_interruptions(view(s, sf, "interruptions"))).select("id", "hour", "weekday", "density"),
    "t9_event_features": lambda s, sf: enrich.event_features(view(s, sf, "task_events")),
    "t10_nearby_interruptions": lambda s, sf: enrich.nearby_interruptions(view(s, sf, "task_events").where("event_type = 'created'").select("user_id", F.col("id").alias("task_id"), F.col("event_time").alias("created_at")), view(s, sf, "interruptions")),
}
SQL = {
    "v_issues": with_views(_ISSUES_SQL, "dirty_events", "interruptions", "tasks"),
    "v_issue_summary": with_views("WITH i AS (" + _ISSUES_SQL.replace("\nWITH e AS (", "SELECT * FROM (WITH e AS (", 1) + ")) SELECT stage, severity, rule, count(*) AS issues FROM i GROUP BY ALL", "dirty_events", "interruptions", "tasks"),
    "v13_model_input": with_views("""WITH m AS (SELECT task_id, category, priority, location_id, hour(created_at) + CASE WHEN task_id % 97 = 0 THEN 24 ELSE 0 END AS hour, task_id % 101 - 1 AS n_prior, task_id % 13 / 11.0 AS done_rate FROM tasks)
      SELECT 'model_input' AS stage, 'error' AS severity, rule, task_id AS row_key FROM (SELECT task_id, unnest([CASE WHEN category NOT IN ('general', 'PROMO') THEN 'category_domain' END, CASE WHEN location_id NOT IN (0, 1, 2, 3) THEN 'location_domain' END, CASE WHEN hour NOT BETWEEN 0 AND 23 THEN 'out_of_range:hour' END, CASE WHEN n_prior < 0 THEN 'negative:n_prior' END, CASE WHEN done_rate NOT BETWEEN 0 AND 1 THEN 'out_of_range:done_rate' END]) AS rule FROM m) WHERE rule IS NOT NULL""", "tasks"),
    "v14_leakage_audit": with_views("""WITH s AS (SELECT task_id, avg(CASE WHEN status = 'forgotten' THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY user_id ORDER BY created_at, task_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a FROM tasks),
      b AS (SELECT task_id, avg(CASE WHEN status = 'forgotten' THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY user_id ORDER BY epoch_us(created_at) RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM tasks)
      SELECT count(*) AS checked, count(*) FILTER (abs(coalesce(r, -1) - coalesce(CASE WHEN task_id % 50 = 0 THEN coalesce(a, 0) + 0.1 ELSE a END, -1)) > 5e-3) AS leaks FROM s JOIN b USING (task_id)""", "tasks"),
    "c_events": with_views("SELECT id, user_id, task_id, lower(trim(event_type)) AS event_type, event_time FROM dirty_events QUALIFY row_number() OVER (PARTITION BY user_id, task_id, event_type, event_time ORDER BY id) = 1", "dirty_events"),
    "c_interruptions": with_views(f"WITH {_CLEAN_I} SELECT * FROM ci", "interruptions"),
    "c_tasks": with_views(f"SELECT task_id, status, {_ALIAS_SQL} AS category, priority, coalesce(epoch_us(completed_at) - epoch_us(started_at) > 43200000000, false) AS is_anomaly FROM tasks", "tasks"),
    "c12_cleaning_report": with_views("""SELECT 'events' AS table_name, 'duplicates_removed' AS operation, count(*) - count(DISTINCT (user_id, task_id, event_type, event_time)) AS rows FROM dirty_events
      UNION ALL SELECT 'events', 'types_normalised', count(*) FILTER (event_type <> lower(event_type)) FROM dirty_events
      UNION ALL SELECT 'interruptions', 'duplicates_removed', count(*) - count(DISTINCT (user_id, task_id, interruption_type, start_time)) FROM interruptions
      UNION ALL SELECT 'interruptions', 'durations_filled', count(*) FILTER (duration_seconds IS NULL) FROM interruptions
      UNION ALL SELECT 'interruptions', 'ends_filled', count(*) FILTER (end_time IS NULL) FROM interruptions
      UNION ALL SELECT 'tasks', 'duplicates_removed', 0 UNION ALL SELECT 'tasks', 'categories_normalised', count(*) FILTER (lower(category) IN (""" + _in(ALIASES) + """)) FROM tasks
      UNION ALL SELECT 'tasks', 'priorities_clamped', count(*) FILTER (task_id % 10 < 2) FROM tasks UNION ALL SELECT 'tasks', 'anomalies_flagged', count(*) FILTER (epoch_us(completed_at) - epoch_us(started_at) > 43200000000) FROM tasks""", "dirty_events", "interruptions", "tasks"),
    "c1_to_utc": with_views("SELECT id, CASE WHEN id % 50 <> 0 AND id % 51 <> 0 THEN date_trunc('second', event_time) END AS event_time FROM task_events", "task_events"),
    "c9_category_aliases": f"WITH p AS (SELECT p_partkey, list_extract([{_in(_SPELLINGS)}], CAST(p_partkey % {len(_SPELLINGS)} + 1 AS INT)) AS c FROM part) SELECT p_partkey, CASE c " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in CATEGORY_ALIASES.items()) + f" ELSE c END AS category, c IN ({_in(CATEGORY_ALIASES)}) AS category_changed FROM p",
    "c10_clamped_tasks": with_views("SELECT task_id, CASE WHEN task_id % 10 = 0 THEN 5 WHEN task_id % 10 = 1 THEN 1 ELSE priority END AS priority, task_id % 10 < 2 AS priority_clamped FROM tasks", "tasks"),
    "v3_invalid_timestamps": with_views("SELECT 'events' AS stage, 'error' AS severity, 'invalid_timestamp' AS rule, id AS row_key FROM task_events WHERE id % 50 = 0", "task_events"),
    "v12_verdict": with_views("WITH i AS (" + _ISSUES_SQL.replace("\nWITH e AS (", "SELECT * FROM (WITH e AS (", 1) + ")) SELECT count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'error') = 0 AS is_clean FROM i", "dirty_events", "interruptions", "tasks"),
    "q1_table_counts": with_views("SELECT 'task_events' AS table_name, count(*) AS rows, 6 AS columns FROM task_events UNION ALL SELECT 'interruptions', count(*), 8 FROM interruptions UNION ALL SELECT 'tasks', count(*), 12 FROM tasks UNION ALL SELECT 'locations', count(*), 3 FROM locations", "task_events", "interruptions", "tasks", "locations"),
    "c13_tag_category": "SELECT p_partkey, CASE WHEN lower(p_name) = 'part 1' THEN 'first' WHEN contains(lower(p_name), '9') THEN 'nine' WHEN contains(lower(p_name), '5') THEN 'five' WHEN contains(lower(p_name), '1') THEN 'one' ELSE 'other' END AS tag FROM part",
    "t_events": with_views("""SELECT id, CAST(hour(event_time) AS INT) AS hour, dayname(event_time) AS weekday_name, CAST(isodow(event_time) - 1 AS INT) AS weekday, hour(event_time) >= 21 AS is_late_night,
      (epoch_us(event_time) - epoch_us(lag(event_time) OVER w)) / 1e6 AS inter_event_gap_s, CAST(coalesce(sum(CASE WHEN event_type IN ('started', 'resumed') THEN 1 ELSE 0 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS session_index
      FROM task_events WINDOW w AS (PARTITION BY task_id ORDER BY event_time, id)""", "task_events"),
    "t_tasks": with_views("""WITH d AS (SELECT t.*, category || '@' || coalesce(location_type, 'UNKNOWN') AS pair FROM tasks t LEFT JOIN locations l ON t.location_id = l.id)
      SELECT task_id, pair AS task_location_pair, round((epoch_us(started_at) - epoch_us(created_at)) / 3.6e9, 3) AS start_delay_h, round((epoch_us(completed_at) - epoch_us(started_at)) / 3.6e9, 3) AS duration_h, round((epoch_us(deadline_at) - epoch_us(created_at)) / 3.6e9, 3) AS deadline_h,
      coalesce(hour(started_at) >= 21, false) AS is_late_night_start, row_number() OVER (PARTITION BY user_id, pair ORDER BY created_at, task_id) > 1 AS is_repeated_context FROM d""", "tasks", "locations"),
    "t8_interruptions": with_views(f"WITH {_CLEAN_I} SELECT id, CAST(hour(start_time) AS INT) AS hour, CAST(isodow(start_time) - 1 AS INT) AS weekday, round(1 / (nullif(duration_seconds, 0) / 60.0), 4) AS density FROM ci", "interruptions"),
    "t9_event_features": with_views("""WITH g AS (SELECT task_id, min(event_time) FILTER (event_type = 'created') AS created_at, min(event_time) FILTER (event_type = 'started') AS started_at, count(*) AS event_count, count(*) FILTER (event_type IN ('paused', 'resumed')) AS switch_count FROM task_events GROUP BY task_id)
      SELECT *, CAST(hour(coalesce(created_at, started_at)) AS INT) AS hour, hour(coalesce(created_at, started_at)) >= 21 OR hour(coalesce(created_at, started_at)) <= 4 AS is_late, isodow(coalesce(created_at, started_at)) >= 6 AS is_weekend FROM g""", "task_events"),
    "t10_nearby_interruptions": with_views(_NEARBY, "task_events", "interruptions"),
}
SQL["c12_written_and_counted"] = SQL["c12_cleaning_report"]
