"""Queries over associations, recommendations, patterns and streams, with SQL where it can express them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import associate, metrics, patterns, sessions
from ..sources import tables
from ..streaming import streams
from .views import view, with_views
from .work import BASE, CTX, DAILY, S, ST, _OPEN, _base, _ctx, _interruptions, _sessions, _status, _tasks_of_events

SUPPORT, CONFIDENCE = 0.005, 0.02
_B = lambda s, sf: view(s, sf, "baskets")


def _pairs(s, sf):
    return associate.pair_rules(_B(s, sf), SUPPORT, CONFIDENCE)


def _scoped(s, sf):
    return associate.pair_rules(_B(s, sf), SUPPORT, CONFIDENCE, "context")


def mined(s, sf):
    items = associate.baskets(_B(s, sf), ["basket_id"], "item", 1)
    sets = associate.itemsets(items, SUPPORT)
    return associate.rules(sets, items.count(), CONFIDENCE).select(F.array_join("antecedents", ",").alias("a"), F.array_join("consequents", ",").alias("c"), "support", "confidence", "lift", "leverage", "conviction")


def _feedback(s, sf):
    o = s.read.parquet(f"{sf}/orders.parquet")
    action = F.when(F.col("o_orderstatus") == "F", "ACCEPTED").when(F.col("o_orderstatus") == "O", "DISMISSED").otherwise("DEFERRED")
    return o.select(F.col("o_orderkey").alias("fid"), (F.col("o_custkey") % 500).alias("rec_id"), F.concat(F.lit("Brand#"), (F.col("o_custkey") % 25 + 1).cast("string")).alias("antecedent"), action.alias("action"), F.col("o_orderdate").cast("timestamp").alias("at"))


def _weighted(s, sf):
    return associate.weighted_confidence(_pairs(s, sf), associate.acceptance_weights(_feedback(s, sf), "antecedent"), "antecedent")


def _rules(s, sf, pairs):
    """Rules of pairs, or of itemsets of every size, and those without antecedents, with the weights of their first
    antecedents."""
    if pairs:
        found = _pairs(s, sf).select(F.array("antecedent").alias("antecedents"), F.array("consequent").alias("consequents"), "support", "confidence", "lift")
    else:
        items = associate.baskets(_B(s, sf), ["basket_id"], "item", 1)
        found = associate.rules(associate.itemsets(items, SUPPORT), items.count(), CONFIDENCE).select("antecedents", "consequents", "support", "confidence", "lift")
    found = found.unionByName(associate.general_rules(associate.popularity_rules(_B(s, sf)))).withColumn("antecedent", F.try_element_at("antecedents", F.lit(1)))
    return associate.weighted_confidence(found, associate.acceptance_weights(_feedback(s, sf), "antecedent"), "antecedent").drop("antecedent")


def recommended(s, sf, pairs=True):
    done = associate.baskets(_B(s, sf), ["basket_id"], "item", 2).select(F.col("basket_id").alias("visit_id"), F.col("items").alias("done"))
    return associate.recommend(tables.stored(_rules(s, sf, pairs), "rules"), done, 0.0, 0.0, 0.0).withColumn("antecedents", F.array_join("antecedents", ","))


HIDE_S = 400 * 86_400  # a customer's orders are months apart


def _recommended_in_context(s, sf):
    """Recommendations for every visit by its context's rules, without what the user was shown or dismissed there in the
    time before: the items of earlier visits with an even number."""
    rows = tables.stored(view(s, sf, "visits"), "visits")
    pairs = associate.pair_rules(rows, 0.05, 0.5, "context")
    found = pairs.select("context", F.array("antecedent").alias("antecedents"), F.array("consequent").alias("consequents"), "support", "confidence", "lift")
    found = found.unionByName(associate.general_rules(associate.popularity_rules(rows, "context", support=0.05, confidence=0.5, lift=1.0)))
    found = tables.stored(found.withColumn("weighted_confidence", F.col("confidence")), "rules")
    visits = tables.stored(rows.groupBy("basket_id", "user_id", "context", "t").agg(F.array_sort(F.collect_set("item")).alias("done")).withColumnRenamed("basket_id", "visit_id"), "done")
    marks = rows.where("basket_id % 2 = 0").select("user_id", "context", F.col("item").alias("task"), (F.col("t") + 1).alias("t"))
    hidden = associate.hidden_tasks(visits, marks, HIDE_S)
    return associate.recommend(found, visits.select("visit_id", "context", "done"), hidden=hidden).withColumn("antecedents", F.array_join("antecedents", ","))


def _context_rules(s, sf):
    """Rules of every size by context; items are five kinds, so that baskets of three and more are common."""
    d = associate.context_rules(view(s, sf, "visits").select("basket_id", "context", "item"), 0.1, 0.3, 1.0)
    return d.select("context", F.array_join("antecedents", ",").alias("a"), F.array_join("consequents", ",").alias("c"), "support", "confidence", "lift", "leverage", "conviction")


def _popular(s, sf):
    w = associate.acceptance_weights(_feedback(s, sf), "antecedent").withColumnRenamed("antecedent", "consequent")
    return associate.popularity_rules(_B(s, sf), "context", support=0.15, confidence=0.15, lift=1.0, weights=w)


def _shown(s, sf):
    e = view(s, sf, "task_events").where("event_type IN ('resumed', 'paused')")
    return e.select("id", "user_id", "task_id", "event_time", F.unix_seconds("event_time").alias("t"), (F.col("id") % 5 == 0).alias("dismissed"))


def _predictions(s, sf):
    t = view(s, sf, "task_events").groupBy("user_id", "task_id").agg(F.count_if(F.col("event_type") == "forgotten").alias("forgotten"), F.count("*").alias("n"))
    return t.withColumn("probability", F.round(F.col("forgotten") / F.col("n") * 5, 6)).withColumn("risk_level", F.when(F.col("forgotten") >= 2, "HIGH").otherwise("LOW"))


def _detected(s, sf):
    return associate.detect(_predictions(s, sf), _context(s, sf), _links(s, sf))


def _context(s, sf):
    """What a user's sessions cost, and the category with most switches."""
    x = _sessions(s, sf).join(_tasks_of_events(s, sf).select("task_id", "category"), "task_id").where("category IS NOT NULL")
    most = x.groupBy("user_id", "category").agg(F.sum("context_switch_count").alias("k")).where("k > 0").groupBy("user_id").agg(F.max_by("category", F.struct("k", "category")).alias("affected_category"))
    return _base(s, sf).join(most, "user_id", "left").select("user_id", "switches", (F.col("interruption_s") / 60).alias("interruption_minutes"), (F.col("switches") * 5.0).alias("recovery_minutes"), "affected_category")


def _links(s, sf):
    return _predictions(s, sf).select("user_id", "task_id", F.round(F.col("n") / 30, 6).alias("confidence"), (F.col("task_id") % 3 * 1.0).alias("lift"))


def _daily_friction(s, sf):
    return metrics.daily_friction(_status(s, sf), _interruptions(s, sf), _sessions(s, sf))


def _linked(s, sf):
    return _links(s, sf).select("user_id", (F.col("task_id") % 5).alias("context"), F.col("task_id").alias("task"), "confidence")


def _risks(s, sf):
    return _predictions(s, sf).where("task_id % 3 > 0").select("user_id", F.col("task_id").alias("task"), F.least("probability", F.lit(1.0)).alias("probability"), F.col("task_id").alias("id"))


def summarised(s, sf):
    return associate.daily_summary(ranked(s, sf), _risks(s, sf), _linked(s, sf), _context(s, sf))


def all_patterns(s, sf):
    """Every kind of pattern as rows of (kind, subject, value), each known by a digest of kind and subject."""
    ctx = tables.stored(_ctx(s, sf), "sessions")
    out = lambda d, kind, subject, value: d.select(F.lit(kind).alias("kind"), subject.alias("subject"), value.cast("double").alias("value"))
    of = F.concat_ws(":", *[F.col(c).cast("string") for c in ("user_id", "task_id", "seq")])
    return patterns.all_patterns(
        out(patterns.frequency_patterns(ctx), "frequency", F.concat_ws("@", "kind", F.col("task_category").cast("string"), F.col("context").cast("string")), F.col("confidence")),
        out(patterns.resume_delay_pattern(ctx, 36_000), "resume_delay", of, F.col("avg_delay")),
        out(patterns.clusters(ctx), "cluster", F.col("cluster").cast("string"), F.col("share")),
        out(patterns.anomalies(ctx), "anomaly", of, F.col("score")),
    )


def ranked(s, sf):
    return associate.rank_insights(_detected(s, sf)).select("user_id", "insight", "subject", "priority", "score", "band", "position")


def prioritised(s, sf):
    p = _predictions(s, sf)
    recs = p.select("user_id", "task_id", F.round(F.col("n") / 40, 6).alias("confidence"))
    risk = p.where("task_id % 3 > 0").select("user_id", "task_id", F.round("probability", 4).alias("risk"))
    return associate.prioritise(recs, risk)


def predictions_view(s, sf):
    e = view(s, sf, "task_events").select("id", "task_id", F.col("event_time").alias("valid_from"), F.when(F.col("id") % 3 == 0, "HIGH").otherwise("LOW").alias("risk_level"))
    return associate.current_predictions(e, "HIGH")


def _stats(s, sf):
    recs = s.read.parquet(f"{sf}/orders.parquet").select((F.col("o_custkey") % 600).alias("rec_id")).distinct().withColumn("at", F.lit("2024-01-01").cast("timestamp"))
    return associate.feedback_stats(recs, _feedback(s, sf))


def faithful(s, sf):
    c = s.read.parquet(f"{sf}/conversations.parquet")
    d = c.select("conv_id", "turn", "text", F.array(F.col("turn").cast("double"), F.col("conv_id").cast("double"), F.lit(0.5)).alias("payload"))
    return associate.unfaithful_numbers(d, "text", "payload").select("conv_id", "turn", "unfaithful", "faithful")


def _streamed(spark, sf, name, columns, op, mode="append"):
    """Run a stream operator over a view's rows: they are written as files once, read as a stream with availableNow, and
    its output is read back from the shared folder."""
    return _streamed_rows(spark, view(spark, sf, name).select(*columns), op, mode)


def _streamed_rows(spark, rows, op, mode="append"):
    at = f"{tables.shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows.write.parquet(f"{at}/in")
    out = op(spark.readStream.schema(rows.schema).parquet(f"{at}/in"))
    if mode == "append":
        q = out.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    else:  # update: a batch's rows replace those of earlier batches
        q = out.writeStream.outputMode(mode).foreachBatch(lambda d, i: d.withColumn("_batch", F.lit(i)).write.mode("append").parquet(f"{at}/out")).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(out.schema if mode == "append" else out.schema.add("_batch", "long")).parquet(f"{at}/out")


def _ended(rows, stamp, **of):
    """``rows`` and one far in the future, which moves the watermark past all others; ``of`` gives its columns, else null."""
    end = rows.sparkSession.range(1).select(*[F.lit("2030-01-01" if c == stamp else of.get(c)).cast(t).alias(c) for c, t in rows.dtypes])
    return rows.unionByName(end)


def _visits(s, sf):
    """Streamed visits; the last event closes the open ones and is left out."""
    e = view(s, sf, "context_events").select("user_id", "task_id", "context", "ts", "event_type")
    rows = _ended(e, "ts", user_id=-1, task_id=-1, context=-1, event_type="COMPLETE")
    return _streamed_rows(s, rows, streams.visit_sessions).where("user_id >= 0").withColumn("tasks", F.array_sort("tasks"))


def _streamed_sessions(s, sf, hold_ms=None):
    rows = _ended(view(s, sf, "task_events").select(*EV), "event_time", id=-1, user_id=-1, task_id=-1, event_type="paused")
    return _streamed_rows(s, rows, lambda d: streams.lifecycle_sessions(d, hold_ms=hold_ms))


def _streamed_cooldown(s, sf):
    rows = view(s, sf, "task_events").where("event_type IN ('resumed', 'paused')").select("id", "user_id", "task_id", "event_time", (F.col("id") % 5 == 0).alias("dismissed"))
    return _streamed_rows(s, _ended(rows, "event_time", id=-1, user_id=-1, task_id=-1), streams.cooldown).where("id >= 0")


def _metric_table(s, sf):
    """Daily counts streamed into a metric table of a partition a day, and the table."""
    at = f"{tables.shared_dir(s)}/metrics-{uuid.uuid4().hex}"
    rows = view(s, sf, "task_events").select(*EV)
    rows.write.parquet(f"{at}/in")
    streams.daily_metrics(s.readStream.schema(rows.schema).parquet(f"{at}/in"), f"{at}/table", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return s.read.schema("user_id long, n long, day date").parquet(f"{at}/table")


def _last(df, *keys):
    return df.groupBy(*keys).agg(*[F.max_by(c, "_batch").alias(c) for c in df.columns if c not in (*keys, "_batch")])


def _put(s, df):
    path = f"{tables.shared_dir(s)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def _written_view(s, sf, name, read):
    return read(_put(s, view(s, sf, name)))


def csv_round_trip(s, sf):
    """Events written as CSV and read again with the declared schema."""
    path = f"{tables.shared_dir(s)}/csv-{uuid.uuid4().hex}"
    e = view(s, sf, "task_events").select(F.col("id").cast("string").alias("id"), F.col("task_id").cast("string").alias("task_id"), F.col("user_id").cast("string").alias("user_id"), "event_type", F.col("event_time").alias("occurred_at"), F.col("location_id").cast("string").alias("location_id"))
    tables.write_csv_tables({"task_events": e}, path)
    return s.read.schema(tables.CSV_SCHEMAS["task_events"]).option("header", True).csv(f"{path}/task_events.csv")


def exported(s, sf):
    """A dataset exported by split, and what its features' folder has."""
    path = f"{tables.shared_dir(s)}/dataset-{uuid.uuid4().hex}"
    d = view(s, sf, "tasks").select("task_id", "priority", (F.col("status") == "forgotten").cast("int").alias("y"), F.when(F.col("task_id") % 5 == 0, "test").otherwise("train").alias("split"))
    tables.export_dataset(d, path, "y", "task_id")
    of = lambda *columns: d.select(*columns, "split").schema
    features, labels = s.read.schema(of("task_id", "priority")).parquet(f"{path}/features"), s.read.schema(of("task_id", "y")).parquet(f"{path}/labels")
    return features.join(labels.drop("split"), "task_id").groupBy("split").agg(F.count("*").alias("rows"), F.sum("y").alias("positive"), F.sum("priority").alias("priorities"))


EV = ["id", "user_id", "task_id", "event_type", "event_time"]
QUERIES = {
    "a2_pair_itemsets": lambda s, sf: associate.itemsets(associate.baskets(_B(s, sf), ["basket_id"], "item", 1), SUPPORT).where(F.size("itemset") <= 2).select(F.array_join("itemset", ",").alias("itemset"), "freq"),
    "a1_baskets": lambda s, sf: associate.baskets(_B(s, sf), ["basket_id", "context"], "item"),
    "a3_rules": mined,
    "a4_popularity": lambda s, sf: associate.popularity_rules(_B(s, sf)),
    "a4_popularity_in_context": _popular,
    "a5_rules_by_context": _scoped,
    "a5_context_rules": _context_rules,
    "a6_pair_rules": _pairs,
    "a7_acceptance": lambda s, sf: associate.acceptance_weights(_feedback(s, sf), "antecedent"),
    "a8_weighted_confidence": _weighted,
    "g1_recommend": recommended,
    "g1_recommend_in_context": _recommended_in_context,
    "g1_recommend_itemsets": lambda s, sf: recommended(s, sf, False),
    "g2_cooldown": lambda s, sf: associate.suppressed(_shown(s, sf)).select("id", "hidden"),
    "g3_prioritise": prioritised,
    "g4_detectors": _detected,
    "g5_friction_trend": lambda s, sf: associate.friction_trend(_daily_friction(s, sf)),
    "g6_ranking": ranked,
    "g7_recommendations": lambda s, sf: associate.associate_recommendations(_linked(s, sf), _risks(s, sf)),
    "g8_daily_summary": summarised,
    "k10_rule_report": lambda s, sf: associate.rule_report(_scoped(s, sf).select("context", F.array("antecedent").alias("antecedents"), F.array("consequent").alias("consequents"), "support", "confidence", "lift")),
    "k10_session_report": lambda s, sf: sessions.session_report(_ctx(s, sf)),
    "g9_current_predictions": predictions_view,
    "g10_feedback": _stats,
    "g11_follow_up": lambda s, sf: associate.follow_up_tasks(_stats(s, sf)),
    "g12_faithful_numbers": faithful,
    "p1_frequency": lambda s, sf: patterns.frequency_patterns(_ctx(s, sf)),
    "p1_frequency_low": lambda s, sf: patterns.frequency_patterns(_ctx(s, sf), z=0.05),
    "p2_resume_delay": lambda s, sf: patterns.resume_delay_pattern(_ctx(s, sf), 36_000),
    "p2_resume_delay_30s": lambda s, sf: patterns.resume_delay_pattern(_ctx(s, sf)),
    "p6_all_patterns": all_patterns,
    "p3_clusters": lambda s, sf: patterns.clusters(_ctx(s, sf)),
    "p5_anomalies": lambda s, sf: patterns.anomalies(_ctx(s, sf)),
    "k1_read_since": lambda s, sf: tables.read_rows(s, f"{sf}/events.parquet", "ts", "2024-01-15", None, ["event_id", "user_id", "event_type"]),
    "k2_read_interruptions": lambda s, sf: _written_view(s, sf, "interruptions", lambda p: tables.read_interruptions(s, p, "2024-01-10")).select("id", "user_id", "start_time", "duration_seconds"),
    "k3_read_sessions": lambda s, sf: tables.read_sessions(s, _put(s, _sessions(s, sf)), "2024-01-10").select("session_id", "user_id", "session_start"),
    "k5_read_events": lambda s, sf: _written_view(s, sf, "task_events", lambda p: tables.read_events(s, p, "2024-01-10")).select("id", "location_id", "event_time"),
    "k6_csv_round_trip": csv_round_trip,
    "k8_export": exported,
    "k4_labels": lambda s, sf: tables.location_labels(view(s, sf, "locations")),
    "x1_latest_status": lambda s, sf: _last(_streamed(s, sf, "task_events", EV, streams.latest_status, "update"), "task_id").select("task_id", "status", "started_at"),
    "x2_sessions": lambda s, sf: _streamed_sessions(s, sf, 30 * 86_400_000),
    "x2_sessions_30m": _streamed_sessions,
    "x3_visits": lambda s, sf: _visits(s, sf),
    "x4_cooldown": _streamed_cooldown,
    "k7_daily_metrics": _metric_table,
    "x5_dedup": lambda s, sf: _streamed(s, sf, "task_events", EV, lambda d: streams.dedup(d, ["user_id", "task_id", "event_type", "event_time"], "event_time")),
    "x6_daily_counts": lambda s, sf: _last(_streamed(s, sf, "task_events", EV, lambda d: streams.daily_counts(d, "event_time"), "update"), "user_id", "day"),
}


def _rules_sql(scope, support=SUPPORT, confidence=CONFIDENCE):
    k, p = (f"{scope}, ", f"PARTITION BY {scope}") if scope else ("", "")
    on = f"i.{scope} = n.{scope}" if scope else "true"
    using = f"{scope}, " if scope else ""
    return f"""n AS (SELECT {k}count(DISTINCT basket_id) AS n FROM baskets {'GROUP BY ' + scope + ' HAVING count(DISTINCT basket_id) >= 2' if scope else ''}),
 it AS (SELECT i.*, n.n FROM (SELECT {k}item, count(*) AS f FROM baskets GROUP BY ALL) i JOIN n ON {on} WHERE f >= {support} * n.n),
 pr AS (SELECT {'a.' + scope + ', ' if scope else ''}a.item AS antecedent, b.item AS consequent, count(*) AS freq FROM baskets a JOIN baskets b ON a.basket_id = b.basket_id AND a.item <> b.item GROUP BY ALL),
 m AS (SELECT pr.*, x.f AS fa, y.f AS fc, x.n FROM pr JOIN it x ON pr.antecedent = x.item {f'AND pr.{scope} = x.{scope}' if scope else ''} JOIN it y ON pr.consequent = y.item {f'AND pr.{scope} = y.{scope}' if scope else ''}),
 ru AS (SELECT {k}antecedent, consequent, round(freq / n::DOUBLE, 6) AS support, round(freq / fa::DOUBLE, 6) AS confidence, round(freq / fa::DOUBLE / (fc / n::DOUBLE), 6) AS lift, round(freq / n::DOUBLE - fa / n::DOUBLE * (fc / n::DOUBLE), 6) AS leverage, CASE WHEN freq < fa THEN round((1 - fc / n::DOUBLE) / (1 - freq / fa::DOUBLE), 6) END AS conviction FROM m),
 rules AS (SELECT * FROM ru WHERE support >= {support} AND confidence >= {confidence})"""


_FB = "fb AS (SELECT o_orderkey AS fid, o_custkey % 500 AS rec_id, 'Brand#' || (o_custkey % 25 + 1) AS antecedent, CASE o_orderstatus WHEN 'F' THEN 'ACCEPTED' WHEN 'O' THEN 'DISMISSED' ELSE 'DEFERRED' END AS action, o_orderdate AS at FROM orders)"
_W = "aw AS (SELECT antecedent, count(*) FILTER (action = 'ACCEPTED') AS accepted, count(*) FILTER (action = 'DISMISSED') AS dismissed, coalesce(round(1 + 4 * count(*) FILTER (action = 'ACCEPTED') / nullif(count(*) FILTER (action IN ('ACCEPTED', 'DISMISSED')), 0)::DOUBLE, 6), 1) AS weight FROM fb GROUP BY antecedent)"
_WR = "wr AS (SELECT rules.*, round(confidence * least(greatest(coalesce(weight, 1), 1), 5), 6) AS weighted_confidence FROM rules LEFT JOIN aw USING (antecedent))"
_PRED = "pd AS (SELECT user_id, task_id, count(*) FILTER (event_type = 'forgotten') AS forgotten, count(*) AS n, round(count(*) FILTER (event_type = 'forgotten') / count(*)::DOUBLE * 5, 6) AS probability, CASE WHEN count(*) FILTER (event_type = 'forgotten') >= 2 THEN 'HIGH' ELSE 'LOW' END AS risk_level FROM task_events GROUP BY ALL)"
_CX = f"""{BASE}, {_PRED}, sc AS (SELECT ms.user_id, p_type AS category, sum(context_switch_count) AS k FROM ms JOIN part ON p_partkey = task_id % 200 + 1 GROUP BY ALL HAVING sum(context_switch_count) > 0), mc AS (SELECT user_id, arg_max(category, (k, category)) AS affected_category FROM sc GROUP BY user_id),
 cx AS (SELECT user_id, switches, interruption_s / 60.0 AS im, switches * 5.0 AS rm, affected_category FROM base LEFT JOIN mc USING (user_id)), lk AS (SELECT user_id, task_id % 5 AS context, task_id AS task, round(n / 30.0, 6)::DOUBLE AS confidence FROM pd), rk AS (SELECT user_id, task_id AS task, least(probability, 1.0) AS probability FROM pd WHERE task_id % 3 > 0)"""
_DET = f"""{_CX}, det AS (
 SELECT user_id, 'frequent_forgetting' AS insight, 'frequent_forgetting' AS type, CASE WHEN probability >= 0.75 THEN 'HIGH' WHEN probability >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS priority, CAST(NULL AS DOUBLE) AS minutes, probability AS confidence, CAST(forgotten AS DOUBLE) AS frequency, CAST(task_id AS VARCHAR) AS subject FROM pd WHERE forgotten >= 3
 UNION ALL SELECT user_id, 'high_risk', 'frequent_forgetting', 'HIGH', NULL, probability, NULL, CAST(task_id AS VARCHAR) FROM pd WHERE probability >= 0.75 OR risk_level = 'HIGH'
 UNION ALL SELECT user_id, 'affected_category', 'affected_category', 'MEDIUM', NULL, NULL, NULL, affected_category FROM cx WHERE affected_category IS NOT NULL
 UNION ALL SELECT user_id, 'context_switching', 'context_switching', CASE WHEN switches >= 10 THEN 'HIGH' ELSE 'MEDIUM' END, CAST(rm AS DOUBLE), NULL, CAST(switches AS DOUBLE), CAST(user_id AS VARCHAR) FROM cx WHERE switches >= 5
 UNION ALL SELECT user_id, 'interruptions', 'interruptions', 'HIGH', CAST(im AS DOUBLE), NULL, NULL, CAST(user_id AS VARCHAR) FROM cx WHERE im >= 15
 UNION ALL SELECT user_id, 'association', 'association', 'MEDIUM', NULL, round(n / 30.0, 6), NULL, CAST(task_id AS VARCHAR) FROM pd WHERE round(n / 30.0, 6) >= 0.7 AND task_id % 3 >= 1.2)"""
_RANKED = f"""{_DET}, k AS (SELECT *, count(*) OVER (PARTITION BY user_id, type) AS c FROM det), scr AS (SELECT *, round(0.3 * least(1, coalesce(frequency, 0) / 10.0) + 0.25 * least(1, coalesce(minutes, 0) / 60) + 0.25 * coalesce(confidence, 0.5) + CASE WHEN c > 1 THEN 0.1 ELSE 0 END + 0.05 + 0.05 * CASE WHEN priority = 'HIGH' THEN 1.0 ELSE 0.5 END, 6) AS score FROM k), rkd AS (SELECT user_id, insight, subject, priority, score, CASE WHEN score >= 0.66 THEN 'HIGH' WHEN score >= 0.33 OR priority = 'HIGH' THEN 'MEDIUM' ELSE 'LOW' END AS band, CAST(row_number() OVER (PARTITION BY user_id ORDER BY score DESC, insight, subject) AS INT) AS position FROM scr)"""
_FST = "fs AS (SELECT r.rec_id, TIMESTAMP '2024-01-01' AS at, count(*) FILTER (action = 'ACCEPTED') AS accepted, count(*) FILTER (action = 'DISMISSED') AS dismissed, count(*) FILTER (action = 'DEFERRED') AS deferred, CASE arg_max(action, (fb.at, fid)) WHEN 'ACCEPTED' THEN 'accepted' WHEN 'DISMISSED' THEN 'dismissed' ELSE 'open' END AS status FROM (SELECT DISTINCT o_custkey % 600 AS rec_id FROM orders) r LEFT JOIN fb ON r.rec_id = fb.rec_id GROUP BY r.rec_id)"
#: Itemsets as sorted lists, grown by one later item, which is exact as an itemset's parts are as frequent as it is at least.
_ALL_SIZES = with_views("""WITH RECURSIVE n AS (SELECT context, count(DISTINCT basket_id) AS n FROM visits GROUP BY context HAVING count(DISTINCT basket_id) >= 2),
  occ AS (SELECT context, basket_id, [item] AS s, item AS last FROM visits UNION ALL SELECT o.context, o.basket_id, list_append(o.s, v.item), v.item FROM occ o JOIN visits v ON v.basket_id = o.basket_id AND v.item > o.last),
  st AS (SELECT context, s, count(*) AS f, n FROM occ JOIN n USING (context) GROUP BY context, s, n HAVING count(*) >= 0.1 * n),
  m AS (SELECT a.context, a.s AS a, c.s AS c, w.f AS freq, a.f AS fa, c.f AS fc, a.n FROM st a JOIN st c ON a.context = c.context AND NOT list_has_any(a.s, c.s) JOIN st w ON w.context = a.context AND w.s = list_sort(list_concat(a.s, c.s))),
  r AS (SELECT context, array_to_string(a, ',') AS a, array_to_string(c, ',') AS c, round(freq / n::DOUBLE, 6) AS support, round(freq / fa::DOUBLE, 6) AS confidence, round(freq / fa::DOUBLE / (fc / n::DOUBLE), 6) AS lift, round(freq / n::DOUBLE - fa / n::DOUBLE * (fc / n::DOUBLE), 6) AS leverage, CASE WHEN freq < fa THEN round((1 - fc / n::DOUBLE) / (1 - freq / fa::DOUBLE), 6) END AS conviction FROM m)
  SELECT * FROM r WHERE confidence >= 0.3 AND lift >= 1.0""", "visits")
_COOLDOWN = with_views("WITH s AS (SELECT id, user_id, task_id, epoch_us(event_time) // 1000000 AS t, id % 5 = 0 AS x FROM task_events WHERE event_type IN ('resumed', 'paused')), k AS (SELECT *, (SELECT max((b.t, b.id)) FROM s b WHERE b.x AND b.user_id = s.user_id AND b.task_id = s.task_id AND (b.t, b.id) < (s.t, s.id)) AS last FROM s) SELECT id, coalesce(t < (SELECT max(b.t) + 3600 FROM s b WHERE b.user_id = k.user_id AND b.task_id = k.task_id AND (b.t, b.id) < (k.t, k.id) AND (k.last IS NULL OR (b.t, b.id) >= k.last)), false) AS hidden FROM k", "task_events")
SQL = {
    "a1_baskets": with_views("SELECT basket_id, context, list_sort(list(item)) AS items FROM baskets GROUP BY ALL HAVING count(*) >= 2", "baskets"),
    "a2_pair_itemsets": with_views(f"WITH n AS (SELECT count(DISTINCT basket_id) AS n FROM baskets) SELECT item AS itemset, count(*) AS freq FROM baskets GROUP BY item HAVING count(*) >= {SUPPORT} * (SELECT n FROM n) UNION ALL SELECT a.item || ',' || b.item, count(*) FROM baskets a JOIN baskets b ON a.basket_id = b.basket_id AND a.item < b.item GROUP BY ALL HAVING count(*) >= {SUPPORT} * (SELECT n FROM n)", "baskets"),
    "a4_popularity": with_views("SELECT item AS consequent, round(count(*) / (SELECT count(DISTINCT basket_id) FROM baskets)::DOUBLE, 6) AS support, round(count(*) / (SELECT count(DISTINCT basket_id) FROM baskets)::DOUBLE, 6) AS confidence, 1.0::DOUBLE AS lift FROM baskets GROUP BY item", "baskets"),
    "a4_popularity_in_context": with_views(f"WITH {_FB}, {_W}, n AS (SELECT context, count(DISTINCT basket_id) AS n FROM baskets GROUP BY context), p AS (SELECT context, item AS consequent, round(count(*) / any_value(n)::DOUBLE, 6) AS support FROM baskets JOIN n USING (context) WHERE n >= 2 GROUP BY ALL HAVING count(*) >= 0.15 * any_value(n)) SELECT context, consequent, support, support AS confidence, 1.0::DOUBLE AS lift, round(support * least(greatest(coalesce(weight, 1), 1), 5), 6) AS weighted_confidence FROM p LEFT JOIN aw ON antecedent = consequent", "baskets"),
    "a5_context_rules": _ALL_SIZES,
    "a5_rules_by_context": with_views(f"WITH {_rules_sql('context')} SELECT * FROM rules", "baskets"),
    "a6_pair_rules": with_views(f"WITH {_rules_sql('')} SELECT * FROM rules", "baskets"),
    "a7_acceptance": f"WITH {_FB}, {_W} SELECT * FROM aw",
    "a8_weighted_confidence": with_views(f"WITH {_rules_sql('')}, {_FB}, {_W}, {_WR} SELECT * FROM wr", "baskets"),
    "g1_recommend": with_views(f"""WITH {_rules_sql('')}, {_FB}, {_W}, {_WR}, v AS (SELECT basket_id, list(item) AS done FROM baskets GROUP BY basket_id HAVING count(*) >= 2), pop AS (SELECT item, count(*) AS f FROM baskets GROUP BY item), nb AS (SELECT count(DISTINCT basket_id) AS n FROM baskets),
      c AS (SELECT v.basket_id AS visit_id, consequent AS task, antecedent AS antecedents, lift, weighted_confidence, support FROM baskets b JOIN v USING (basket_id) JOIN wr ON b.item = antecedent WHERE NOT list_contains(done, consequent) UNION ALL SELECT basket_id, item, '', 1.0, round(f / n::DOUBLE, 6), round(f / n::DOUBLE, 6) FROM v, pop, nb WHERE NOT list_contains(done, item)),
      d AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY visit_id, task ORDER BY lift DESC, weighted_confidence DESC, antecedents) = 1)
      SELECT * FROM (SELECT visit_id, task, antecedents, lift, weighted_confidence, CAST(row_number() OVER (PARTITION BY visit_id ORDER BY weighted_confidence DESC, lift DESC, support DESC, task) AS INT) AS position FROM d) WHERE position <= 5""", "baskets"),
    "g1_recommend_in_context": with_views(f"""WITH baskets AS (SELECT basket_id, context, item FROM visits), {_rules_sql('context', 0.05, 0.5)}, nb AS (SELECT context, count(DISTINCT basket_id) AS n FROM visits GROUP BY context),
      pop AS (SELECT context, item AS consequent, round(count(*) / any_value(n)::DOUBLE, 6) AS support FROM visits JOIN nb USING (context) WHERE n >= 2 GROUP BY ALL HAVING count(*) >= 0.5 * any_value(n)),
      v AS (SELECT basket_id, user_id, context, t, list(item) AS done FROM visits GROUP BY ALL),
      c AS (SELECT v.basket_id AS visit_id, consequent AS task, antecedent AS antecedents, lift, confidence AS w, support FROM visits b JOIN v USING (basket_id) JOIN rules r ON b.item = antecedent AND r.context = v.context WHERE lift >= 1 AND NOT list_contains(done, consequent)
        UNION ALL SELECT basket_id, consequent, '', 1.0, support, support FROM v JOIN pop USING (context) WHERE NOT list_contains(done, consequent)),
      d AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY visit_id, task ORDER BY lift DESC, w DESC, antecedents) = 1),
      h AS (SELECT DISTINCT v.basket_id AS visit_id, m.item AS task FROM v JOIN visits m ON m.basket_id % 2 = 0 AND m.user_id = v.user_id AND m.context = v.context AND m.t + 1 <= v.t AND v.t < m.t + 1 + {HIDE_S})
      SELECT * FROM (SELECT visit_id, task, antecedents, lift, w AS weighted_confidence, CAST(row_number() OVER (PARTITION BY visit_id ORDER BY w DESC, lift DESC, support DESC, task) AS INT) AS position FROM d ANTI JOIN h USING (visit_id, task)) WHERE position <= 5""", "visits"),
    "g2_cooldown": _COOLDOWN,
    "g3_prioritise": with_views(f"WITH {_PRED} SELECT user_id, task_id, round(n / 40.0, 6)::DOUBLE AS confidence, CASE WHEN task_id % 3 > 0 THEN round(probability, 4) END AS risk, round(CASE WHEN task_id % 3 > 0 THEN 0.5 * round(n / 40.0, 6)::DOUBLE + 0.5 * round(probability, 4) ELSE round(n / 40.0, 6)::DOUBLE END, 6) AS priority FROM pd", "task_events"),
    "g4_detectors": with_views(f"WITH {_DET} SELECT * FROM det", "task_events", "interruptions"),
    "g5_friction_trend": with_views(f"WITH {S}, {ST}, {DAILY}, fr AS (SELECT user_id, period_start, value, row_number() OVER (PARTITION BY user_id ORDER BY period_start) - 1 AS i FROM dl WHERE metric_name = 'friction_score'), g AS (SELECT user_id, count(*) AS points, arg_min(value, period_start) AS first, arg_max(value, period_start) AS last, round(regr_slope(value, i), 8) AS slope FROM fr GROUP BY user_id) SELECT user_id, CASE WHEN slope > 0 THEN 'increasing_friction' ELSE 'decreasing_friction' END AS insight, CASE WHEN slope > 0 THEN 'MEDIUM' ELSE 'LOW' END AS priority, first, last, slope, points FROM g WHERE points >= 2 AND slope <> 0", "task_events", "interruptions"),
    "g6_ranking": with_views(f"WITH {_RANKED} SELECT * FROM rkd", "task_events", "interruptions"),
    "g7_recommendations": with_views(f"""WITH {_CX}, d AS (SELECT lk.*, probability AS risk, CASE WHEN probability >= 0.5 THEN 'recurring_forgotten_task_prevention' ELSE 'context_based_reminder' END AS type, greatest(confidence, coalesce(probability, confidence)) AS st FROM lk LEFT JOIN rk USING (user_id, task) WHERE confidence >= 0.5),
      o AS (SELECT user_id, 'rec-' || sha256(user_id || '|' || type || '|' || context || '|' || task)[1:12] AS id, type, context, task, confidence, risk, round(st, 4) AS evidence_strength, round(CASE WHEN risk > 0 THEN risk ELSE confidence END, 4) AS impact_score, CASE WHEN st >= 0.75 THEN 'HIGH' WHEN st >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS priority, round(0.6 * confidence + 0.4 * coalesce(risk, 0), 4) AS rank_score FROM d)
      SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY rank_score DESC, context, task) AS INT) AS position FROM o) WHERE position <= 5""", "task_events", "interruptions"),
    "g8_daily_summary": with_views(f"""WITH {_RANKED}, r AS (SELECT user_id, arg_min(insight, position) AS f, string_agg(insight, ',' ORDER BY position) AS top_insights FROM rkd WHERE position <= 3 GROUP BY user_id), p AS (SELECT user_id, arg_max(task, (probability, -task)) AS highest_risk_task, max(probability) AS highest_risk FROM rk GROUP BY user_id),
      a AS (SELECT user_id, arg_max(context, (confidence, -task)) AS reminder_context FROM lk WHERE confidence >= 0.7 GROUP BY user_id), av AS (SELECT user_id, round(sum(rm), 1)::DOUBLE AS avoidable_minutes FROM cx GROUP BY user_id)
      SELECT user_id, top_insights, highest_risk_task, highest_risk, reminder_context, avoidable_minutes, coalesce(f, CASE WHEN avoidable_minutes IS NOT NULL THEN 'context_switching' END) AS biggest_friction FROM r FULL JOIN p USING (user_id) FULL JOIN a USING (user_id) FULL JOIN av USING (user_id)""", "task_events", "interruptions"),
    "k10_rule_report": with_views(f"WITH {_rules_sql('context')} SELECT context, antecedent AS antecedents, consequent AS consequents, support, confidence, lift FROM rules", "baskets"),
    "k10_session_report": with_views(f"WITH {CTX} SELECT user_id, task_id, seq, task_category, context, session_duration_seconds AS duration_s, focused_time_seconds AS focused_s, interruption_time_seconds AS interruption_s, num_interruptions, num_context_switches AS num_switches, completed FROM cs", "context_events"),
    "g9_current_predictions": with_views("SELECT * FROM (SELECT id, task_id, event_time AS valid_from, CASE WHEN id % 3 = 0 THEN 'HIGH' ELSE 'LOW' END AS risk_level, lead(event_time) OVER w AS valid_until, lead(event_time) OVER w IS NULL AS is_current FROM task_events WINDOW w AS (PARTITION BY task_id ORDER BY event_time, id)) WHERE risk_level = 'HIGH'", "task_events"),
    "g10_feedback": f"WITH {_FB}, {_FST} SELECT * FROM fs",
    "g11_follow_up": f"WITH {_FB}, {_FST} SELECT rec_id, sha256('follow-up|' || rec_id)[1:12] AS task_id, fs.\"at\" + INTERVAL 24 HOUR AS deadline_at FROM fs WHERE status = 'accepted'",
    "g12_faithful_numbers": r"""WITH c AS (SELECT conv_id, turn, list_transform(regexp_extract_all(text, '\d+(?:\.\d+)?'), lambda x: TRY_CAST(x AS DOUBLE)) AS v, [turn::DOUBLE, conv_id::DOUBLE, 0.5] AS p FROM conversations), b AS (SELECT conv_id, turn, CAST(len(list_filter(v, lambda x: x NOT IN (0, 1, 2) AND len(list_filter(p, lambda q: abs(x - q) <= 0.6 OR abs(x - q * 100) <= 0.6)) = 0)) AS INT) AS unfaithful FROM c) SELECT conv_id, turn, coalesce(unfaithful, 0) AS unfaithful, coalesce(unfaithful, 0) = 0 AS faithful FROM b""",
    **{f"p1_frequency{suffix}": with_views(f"""WITH {CTX}, rt AS (SELECT task_category, context, unnest(['interruption', 'switch']) AS kind, unnest([coalesce(num_interruptions / nullif(session_duration_seconds, 0), 0), coalesce(num_context_switches / nullif(session_duration_seconds, 0), 0)]) AS rate FROM cs),
      po AS (SELECT kind, avg(rate) AS population, stddev_pop(rate) AS s FROM rt GROUP BY kind), fg AS (SELECT kind, task_category, context, avg(rate) AS rate, count(*) AS n FROM rt WHERE task_category IS NOT NULL AND context IS NOT NULL GROUP BY ALL HAVING count(*) >= 5), zz AS (SELECT fg.*, population, (rate - population) / CASE WHEN s = 0 THEN 1e-9 ELSE s END AS zs FROM fg JOIN po USING (kind))
      SELECT kind, task_category, context, n, round(rate, 6) AS rate, round(population, 6) AS population, round(zs, 6) AS z, round(least(greatest(zs / 4, 0), 1), 6) AS confidence FROM zz WHERE zs >= {z}""", "context_events") for suffix, z in (("", 1.0), ("_low", 0.05))},
    **{f"p2_resume_delay{suffix}": with_views(f"WITH {CTX}, s AS (SELECT *, list_filter(interruption_durations_seconds, lambda x: x <= {short}) AS sh FROM cs) SELECT user_id, task_id, seq, round(list_avg(resume_delays_seconds), 6) AS avg_delay, round(list_avg(sh), 6) AS avg_short FROM s WHERE num_interruptions >= 2 AND len(sh) >= 1 AND len(resume_delays_seconds) >= 1 AND list_avg(resume_delays_seconds) >= 2 * list_avg(sh)", "context_events") for suffix, short in (("", 36000), ("_30s", 30))},
    "k1_read_since": "SELECT event_id, user_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-15'",
    "k2_read_interruptions": with_views("SELECT id, user_id, start_time, coalesce(duration_seconds, 0) AS duration_seconds FROM interruptions WHERE start_time >= TIMESTAMP '2024-01-10'", "interruptions"),
    "k3_read_sessions": with_views(f"WITH {S} SELECT session_id, user_id, session_start FROM ms WHERE session_start >= TIMESTAMP '2024-01-10'", "task_events", "interruptions"),
    "k5_read_events": with_views("SELECT id, location_id, event_time FROM task_events WHERE event_time >= TIMESTAMP '2024-01-10'", "task_events"),
    "k6_csv_round_trip": with_views("SELECT CAST(id AS VARCHAR) AS id, CAST(task_id AS VARCHAR) AS task_id, CAST(user_id AS VARCHAR) AS user_id, event_type, event_time AS occurred_at, CAST(location_id AS VARCHAR) AS location_id FROM task_events", "task_events"),
    "k8_export": with_views("SELECT CASE WHEN task_id % 5 = 0 THEN 'test' ELSE 'train' END AS split, count(*) AS rows, count(*) FILTER (status = 'forgotten') AS positive, CAST(sum(priority) AS BIGINT) AS priorities FROM tasks GROUP BY split", "tasks"),
    "x3_visits": with_views("""WITH n AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) > 3600000000 OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS nw FROM context_events WHERE event_type = 'COMPLETE' WINDOW w AS (PARTITION BY user_id, context ORDER BY ts, id)),
      v AS (SELECT *, sum(nw) OVER (PARTITION BY user_id, context ORDER BY ts, id) AS visit FROM n) SELECT user_id, context, min(ts) AS visit_start, list_sort(list(DISTINCT task_id)) AS tasks FROM v GROUP BY user_id, context, visit""", "context_events"),
    "k4_labels": with_views("SELECT id, label FROM locations", "locations"),
    "x1_latest_status": with_views(f"WITH {ST} SELECT task_id, status, started_at FROM st", "task_events"),
    **{f"x2_sessions{suffix}": with_views(f"WITH {S} SELECT id AS session_id, user_id, task_id, event_time AS session_start, CASE WHEN nt <= event_time + INTERVAL {hold} THEN nt ELSE event_time + INTERVAL 30 MINUTE END AS session_end FROM n WHERE event_type IN {_OPEN} AND (nt IS NULL OR nt > event_time + INTERVAL {hold} OR nx NOT IN {_OPEN})", "task_events", "interruptions") for suffix, hold in (("", "720 HOUR"), ("_30m", "30 MINUTE"))},
    "x4_cooldown": _COOLDOWN,
    "k7_daily_metrics": with_views("SELECT user_id, CAST(event_time AS DATE) AS day, count(*) AS n FROM task_events GROUP BY ALL", "task_events"),
    "x5_dedup": with_views("SELECT id, user_id, task_id, event_type, event_time FROM task_events QUALIFY row_number() OVER (PARTITION BY user_id, task_id, event_type, event_time ORDER BY id) = 1", "task_events"),
    "x6_daily_counts": with_views("SELECT user_id, CAST(event_time AS DATE) AS day, count(*) AS n FROM task_events GROUP BY ALL", "task_events"),
}
