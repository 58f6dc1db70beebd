"""Queries over features, splits, model evaluation and model fits, with SQL where it can express them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import features, learn, stats
from ..sources.tables import shared_dir, spread_by, stored, stored_by
from .views import AS_OF_EVENTS, view, with_views
from .work import S, ST, STC, _interruptions, _sessions, _status, _tasks_of_events

_T = lambda s, sf: view(s, sf, "tasks")
FEATURES = ["previous_forgetting_count", "previous_completion_count", "completion_rate", "category_forgetting_rate", "location_forgetting_rate", "weekday_forgetting_rate", "hour_forgetting_rate", "task_frequency", "days_since_similar", "deadline_distance_hours", "tasks_today", "repeated_context_count", "is_repeated_context", "forgetting_streak", "is_late_night", "priority", "task_location_pair", "will_forget"]
NUMBERS = ["previous_forgetting_count", "previous_completion_count", "completion_rate", "category_forgetting_rate", "task_frequency", "days_since_similar", "tasks_today", "priority"]
WEIGHTS = {"l_quantity": 0.02, "l_discount": 3.0, "l_tax": -2.0}


def _features(s, sf):
    return features.task_features(spread_by(_T(s, sf), "user_id"))


def _model_input(s, sf):
    """What the models are given, kept, as fits and splits read it many times; other features' windows aren't computed."""
    return stored(_features(s, sf).select("task_id", "created_at", "category", *NUMBERS, "will_forget"), "features")


def _scored(s, sf):
    """A plain score against a label: no model, so that SQL can follow."""
    return _T(s, sf).select("task_id", "user_id", "created_at", "category", (F.col("status") == "forgotten").cast("int").alias("y"), (((F.col("task_id") * 7919) % 1000 + F.when(F.col("status") == "forgotten", 200).otherwise(0)) / 1200.0).alias("p"))


def _two_models(s, sf):
    """Two scores of the same rows: the plain one, and a plainer one."""
    d = _scored(s, sf).withColumn("q", ((F.col("task_id") * 104_729) % 1000) / 1000.0)
    return learn.chronological_split(d, "created_at")


def _by_model(d):
    of = F.explode(F.array(F.struct(F.lit("plain").alias("model"), F.col("p").alias("s")), F.struct(F.lit("plainer").alias("model"), F.col("q").alias("s")))).alias("x")
    return learn.evaluate(d.select("y", of).select("y", "x.model", "x.s"), "y", "s", "model")


def _segments(s, sf):
    of = {"urgent": F.col("priority") >= 4, "late_night": F.hour("created_at") >= 21, "rare": F.col("task_id") % 997 == 0}
    d = _two_models(s, sf).join(_T(s, sf).select("task_id", "priority"), "task_id")
    return learn.segments(d, "y", {"plain": "p", "plainer": "q"}, of)


def fitted_and_chosen(s, sf):
    """Candidates fitted on train, measured on validation, and the chosen one; cross-validation is in l15."""
    d = learn.chronological_split(_model_input(s, sf), "created_at")
    train, val = d.where("split = 'train'"), d.where("split = 'val'")
    out = []
    for model, params in (("logistic", {}), ("forest", {"numTrees": 20}), ("boosted", {"maxIter": 10})):
        out.append(learn.evaluate(learn.score(learn.fit(train, ["category"], NUMBERS, "will_forget", model, **params), val), "will_forget", "p").withColumn("model", F.lit(model)))
    m = stored(out[0].unionByName(out[1]).unionByName(out[2]), "candidates")
    return m.crossJoin(F.broadcast(learn.select_model(m).withColumnRenamed("model", "best"))).withColumn("chosen", F.col("model") == F.col("best")).drop("best")  # one row


def cross_validated(s, sf):
    d = _model_input(s, sf)
    return learn.cv_summary(stored(learn.cross_validate(d, "created_at", "will_forget", lambda train, test: learn.score(learn.fit(train, [], NUMBERS, "will_forget"), test)), "folds"))


def plain_cross_validated(s, sf):
    """The same folds with a score that needs no fit, so that SQL can follow."""
    return learn.cv_summary(learn.cross_validate(_scored(s, sf), "created_at", "y", lambda train, test: test))


def imputed(s, sf):
    """Categories and numbers with gaps, filled as ``preprocess`` does."""
    d = _T(s, sf).select("task_id", F.when(F.col("task_id") % 3 > 0, F.col("category")).alias("category"), F.when(F.col("task_id") % 4 > 0, F.col("priority").cast("double")).alias("priority"))
    from pyspark.ml import Pipeline

    out = Pipeline(stages=learn.preprocess(d, ["category"], ["priority"], False)).fit(d).transform(d)
    return out.select("task_id", F.col("category_f").alias("category"), F.col("priority_i").alias("priority"))


def _points(s, sf):
    return view(s, sf, "task_events").where("event_type = 'created'").select("user_id", F.col("id").alias("task_id"), F.col("event_time").alias("created_at"))


def _fitted(model):
    def run(s, sf):
        d = learn.temporal_split(_model_input(s, sf), "created_at", "task_id")
        train, test = d.where("split = 'train'"), d.where("split = 'test'")
        m = learn.fit(train, ["category"], NUMBERS, "will_forget", model, **({"numTrees": 20} if model == "forest" else {"maxIter": 10} if model == "boosted" else {}))
        return learn.ranking_quality(learn.score(m, test), "will_forget", "p").withColumn("model", F.lit(model))

    return run


def calibrated(s, sf):
    d = learn.chronological_split(_scored(s, sf), "created_at")
    val = d.where("split = 'val'")
    best = stored(learn.best_calibration(val, "y", "p"), "calibrations")
    out = learn.apply_calibration(best, learn.calibrate(val, "y", "p", d.where("split = 'test'")))
    return out.select("task_id", "y", "p", *[F.round(c, 6).alias(c) for c in ("p_isotonic", "p_sigmoid", "p_calibrated")])


def importances(s, sf):
    """A forest's own importances, where attributions aren't at hand."""
    d = _model_input(s, sf)
    return learn.model_importance(learn.fit(d, [], NUMBERS, "will_forget", "forest", numTrees=10), d).withColumn("importance", F.round("importance", 6))


def batch_scores(s, sf):
    """Fit, score the test rows and write them with reasons, then read what was written."""
    d = learn.temporal_split(_model_input(s, sf), "created_at", "task_id")
    m = learn.fit(d.where("split = 'train'"), [], NUMBERS, "will_forget")
    weights = dict(zip(NUMBERS, m.stages[-1].coefficients.toArray().tolist()))
    path = f"{shared_dir(s)}/scores-{uuid.uuid4().hex}"
    learn.score_and_write(m, d.where("split = 'test'"), weights, path, "task_id")
    return s.read.parquet(path).withColumn("p", F.round("p", 6))


def pairwise(s, sf):
    return learn.compare_models(_by_model(_two_models(s, sf).where("split = 'val'")), "roc_auc")


def best_model(s, sf):
    return learn.select_model(_by_model(_two_models(s, sf).where("split = 'val'")))


def ranked_lists(s, sf):
    d = s.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("ranked"), F.array_sort(F.collect_set(F.when(F.col("l_quantity") > 25, F.col("l_partkey")))).alias("relevant"))
    return learn.precision_at(d, 3).select("l_orderkey", "precision", "recall")


def _rate(key):
    w = f"(PARTITION BY user_id{', ' + key if key else ''} ORDER BY epoch_us(created_at) RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"round(count(*) FILTER (status = 'forgotten') OVER {w} / nullif(count(*) FILTER (status IN ('completed', 'forgotten', 'cancelled')) OVER {w}, 0)::DOUBLE, 6)"


_U = "(PARTITION BY user_id ORDER BY epoch_us(created_at) RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_C = _U.replace("user_id", "user_id, category", 1)
_FSQL = f"""WITH k AS (SELECT *, epoch_us(created_at) AS t, isodow(created_at) AS w, hour(created_at) AS h FROM tasks),
 r AS (SELECT *, count(*) OVER {_U} AS rk, count(*) OVER (PARTITION BY user_id ORDER BY t RANGE UNBOUNDED PRECEDING) AS ri FROM k)
 SELECT task_id, count(*) FILTER (status = 'forgotten') OVER {_U} AS previous_forgetting_count, count(*) FILTER (status = 'completed') OVER {_U} AS previous_completion_count,
 round(count(*) FILTER (status = 'completed') OVER {_U} / nullif(count(*) FILTER (status IN ('completed', 'forgotten', 'cancelled')) OVER {_U}, 0)::DOUBLE, 6) AS completion_rate,
 {_rate('category')} AS category_forgetting_rate, {_rate('location_id')} AS location_forgetting_rate, {_rate('w')} AS weekday_forgetting_rate, {_rate('h')} AS hour_forgetting_rate,
 count(*) OVER {_C} AS task_frequency, round((t - max(t) OVER {_C}) / 8.64e10, 6) AS days_since_similar, round((epoch_us(deadline_at) - t) / 3.6e9, 6) AS deadline_distance_hours,
 count(*) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN 86400000000 PRECEDING AND 1 PRECEDING) AS tasks_today, count(*) OVER {_U.replace('user_id', 'user_id, category, location_id', 1)} AS repeated_context_count,
 count(*) OVER {_U.replace('user_id', 'user_id, category, location_id', 1)} > 0 AS is_repeated_context, rk - coalesce(max(CASE WHEN status <> 'forgotten' THEN ri END) OVER {_U}, 0) AS forgetting_streak, h >= 21 AS is_late_night, coalesce(priority, 3) AS priority, category || '@' || coalesce(CAST(location_id AS VARCHAR), 'UNKNOWN') AS task_location_pair, CASE WHEN status = 'forgotten' THEN 1 ELSE 0 END AS will_forget FROM r"""
_SC = "sc AS (SELECT task_id, user_id, created_at, category, CASE WHEN status = 'forgotten' THEN 1 ELSE 0 END AS y, ((task_id * 7919) % 1000 + CASE WHEN status = 'forgotten' THEN 200 ELSE 0 END) / 1200.0 AS p FROM tasks)"


def _rq(key):
    part = f"PARTITION BY {key}" if key else ""
    sel = f"{key}, " if key else ""
    return f"""c AS (SELECT {sel}p AS s, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y <> 1) AS neg, sum((p - y) * (p - y)) AS sq FROM sc GROUP BY ALL),
 w AS (SELECT *, sum(pos) OVER ({part} ORDER BY s DESC) AS tp, sum(neg) OVER ({part} ORDER BY s DESC) AS fp, sum(pos) OVER ({part}) AS P_, sum(neg) OVER ({part}) AS N_ FROM c),
 q AS (SELECT {sel}round(sum(pos * (N_ - fp + neg / 2)) / max(P_ * N_), 6) AS roc_auc, round(sum(pos / P_ * tp / (tp + fp)), 6) AS average_precision, round(sum(sq) / sum(pos + neg), 6) AS brier FROM w {'GROUP BY ' + key if key else ''})"""


_TWO = f"{{}}, {_SC}, sp AS (SELECT sc.*, ((sc.task_id * 104729) % 1000) / 1000.0 AS q, priority FROM sc JOIN spl USING (task_id){{}})"
_EVAL = lambda src, key: f"""m2 AS ({src}), c AS (SELECT {key}, s, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y <> 1) AS neg, sum((s - y) * (s - y)) AS sq FROM m2 GROUP BY ALL),
 w AS (SELECT *, sum(pos) OVER (PARTITION BY {key} ORDER BY s DESC) AS tp, sum(neg) OVER (PARTITION BY {key} ORDER BY s DESC) AS fp, sum(pos) OVER (PARTITION BY {key}) AS P_, sum(neg) OVER (PARTITION BY {key}) AS N_ FROM c),
 q1 AS (SELECT {key}, round(sum(pos * (N_ - fp + neg / 2)) / nullif(max(P_ * N_), 0), 6) AS roc_auc, round(sum(pos / nullif(P_, 0) * tp / (tp + fp)), 6) AS average_precision, round(sum(sq) / sum(pos + neg), 6) AS brier FROM w GROUP BY ALL),
 q2 AS (SELECT {key}, round(coalesce(2 * count(*) FILTER (s >= 0.5 AND y = 1) / nullif(2 * count(*) FILTER (s >= 0.5 AND y = 1) + count(*) FILTER (s >= 0.5 AND y = 0) + count(*) FILTER (s < 0.5 AND y = 1), 0)::DOUBLE, 0), 6) AS f1, count(*) AS rows, round(avg(y), 6) AS positive_rate FROM m2 GROUP BY ALL),
 ev AS (SELECT * FROM q1 JOIN q2 USING ({key}))"""  # noqa: E731
_VAL = "(SELECT sp.* FROM sp JOIN spl USING (task_id) WHERE split = 'val')"
_STACK = "SELECT y, 'plain' AS model, p::DOUBLE AS s{0} FROM {1} UNION ALL SELECT y, 'plainer', q::DOUBLE{0} FROM {1}"
_DAYS = "days AS (SELECT day, row_number() OVER (ORDER BY day) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT CAST(created_at AS DATE) AS day FROM tasks))"
_CHR = f"{_DAYS}, spl AS (SELECT t.*, CASE WHEN k <= floor(n * 0.7) THEN 'train' WHEN k <= floor(n * 0.7) + floor(n * 0.15) THEN 'val' ELSE 'test' END AS split FROM tasks t JOIN days ON CAST(created_at AS DATE) = day)"
_CONF = "tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn)::DOUBLE, 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0), 6) AS f1, round(coalesce(tn / nullif(tn + fp, 0)::DOUBLE, 0), 6) AS specificity"
_ACT = "(SELECT {agg} FROM {src} WHERE {src}.user_id = pt.user_id AND {t} < pt.created_at{lo}) AS {name}"


def _act(name, agg, src, t, lo=None):
    return _ACT.format(agg=agg, src=src, t=t, lo=f" AND {t} >= pt.created_at - INTERVAL {lo}" if lo else "", name=name)


QUERIES = {
    "k8_features_of_buckets": lambda s, sf: features.task_features(stored_by(_T(s, sf), "tasks", "user_id", "created_at")).select("task_id", *FEATURES),
    "f_task_features": lambda s, sf: _features(s, sf).select("task_id", *FEATURES),
    "f_resolved_asof": lambda s, sf: features.resolved_asof_rate(_T(s, sf)),
    "f_activity_features": lambda s, sf: features.activity_features(_points(s, sf), view(s, sf, "task_events"), view(s, sf, "interruptions"), _sessions(s, sf), _status(s, sf)),
    # Histories in chunks: few users have more rows than these here, so the chunks are small.
    "f_task_features_in_chunks": lambda s, sf: features.task_features(stored(spread_by(_T(s, sf), "user_id"), "tasks"), chunk=8).select("task_id", *FEATURES),
    "f_resolved_asof_in_chunks": lambda s, sf: features.resolved_asof_rate(stored(_T(s, sf), "tasks"), chunk=8),
    "f_activity_in_chunks": lambda s, sf: features.activity_features(_points(s, sf), stored(view(s, sf, "task_events"), "events"), view(s, sf, "interruptions"), stored(_sessions(s, sf), "sessions"), stored(_status(s, sf), "tasks"), chunk=200),
    "f20_user_features": lambda s, sf: features.user_features(_status(s, sf), _interruptions(s, sf), _sessions(s, sf), "2024-01-15"),
    "f21_location_features": lambda s, sf: features.location_features(_T(s, sf), "1998-01-01"),
    "f22_online_features": lambda s, sf: features.online_features(_tasks_of_events(s, sf), _interruptions(s, sf), _sessions(s, sf)),
    "l1_temporal_split": lambda s, sf: learn.temporal_split(_T(s, sf), "created_at", "task_id").select("task_id", "split"),
    "l2_chronological_split": lambda s, sf: learn.chronological_split(_T(s, sf), "created_at").select("task_id", "split"),
    "l3_split_audit": lambda s, sf: learn.split_audit(learn.chronological_split(_T(s, sf), "created_at"), "created_at"),
    "l4_split_summary": lambda s, sf: learn.split_summary(learn.chronological_split(_T(s, sf).withColumn("y", (F.col("status") == "forgotten").cast("int")), "created_at"), "created_at", "y"),
    "l5_walk_forward": lambda s, sf: learn.walk_forward(_T(s, sf), "created_at").groupBy("fold", "role").agg(F.count("*").alias("days"), F.min("day").alias("first"), F.max("day").alias("last")),
    "l7_preprocess": imputed,
    "l8_majority": lambda s, sf: learn.majority(_scored(s, sf), "y"),
    "l12_confusion": lambda s, sf: learn.confusion(_scored(s, sf), "y", "p"),
    "l13_ranking_quality": lambda s, sf: learn.ranking_quality(_scored(s, sf), "y", "p"),
    "l14_threshold": lambda s, sf: learn.tune_threshold(_scored(s, sf), "y", "p"),
    **{f"l14_threshold_{m}": (lambda s, sf, m=m: learn.tune_threshold(_scored(s, sf), "y", "p", m)) for m in ("recall", "precision", "accuracy")},
    "l15_cross_validation": plain_cross_validated,
    "l15_cross_validated_fits": cross_validated,
    "l16_best_model": best_model,
    "l16_fitted_and_chosen": fitted_and_chosen,
    "l18_calibration_error": lambda s, sf: learn.calibration_error(_scored(s, sf), "y", "p"),
    "l19_segments": _segments,
    "l19_segments_by_category": lambda s, sf: learn.ranking_quality(_scored(s, sf), "y", "p", "category"),
    "l20_pairwise": pairwise,
    "l21_risk_bands": lambda s, sf: _scored(s, sf).select("task_id", learn.risk_band(F.col("p")).alias("band")),
    "l23_importance": lambda s, sf: learn.global_importance(s.read.parquet(f"{sf}/lineitem.parquet"), WEIGHTS),
    "l24_precision_at": ranked_lists,
    "l9_logistic": _fitted("logistic"),
    "l10_forest": _fitted("forest"),
    "l11_boosted": _fitted("boosted"),
    "l17_calibrated": calibrated,
    "l17_best_calibration": lambda s, sf: learn.best_calibration(learn.chronological_split(_scored(s, sf), "created_at").where("split = 'val'"), "y", "p"),
    "l23_model_importance": importances,
    "q7_completeness": lambda s, sf: stats.completeness(_features(s, sf), FEATURES[:-3]),
    "k9_batch_scores": batch_scores,
}
SQL = {
    "f_task_features": with_views(_FSQL, "tasks"),
    "f_resolved_asof": with_views("SELECT a.task_id, round(count(*) FILTER (b.status = 'forgotten') / nullif(count(b.task_id), 0)::DOUBLE, 6) AS forgetting_rate_asof FROM tasks a LEFT JOIN tasks b ON a.user_id = b.user_id AND b.status IN ('completed', 'forgotten', 'cancelled') AND coalesce(b.completed_at, b.forgotten_at, b.cancelled_at) < a.created_at GROUP BY a.task_id", "tasks"),
    "f_activity_features": with_views(f"WITH {S}, {ST}, rst AS (SELECT user_id, created_at AS t, CASE WHEN status = 'forgotten' THEN 1.0 ELSE 0.0 END AS lost FROM st WHERE status IN ('completed', 'forgotten', 'cancelled')), pt AS (SELECT user_id, id AS task_id, event_time AS created_at FROM task_events WHERE event_type = 'created'), rs AS (SELECT * FROM task_events WHERE event_type = 'resumed'), pa AS (SELECT *, min(CASE WHEN event_type = 'resumed' THEN event_time END) OVER (PARTITION BY task_id ORDER BY event_time, id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS r FROM task_events), rc AS (SELECT *, (epoch_us(r) - epoch_us(event_time)) / 1e6 AS x FROM pa WHERE event_type = 'paused' AND r IS NOT NULL), a AS (SELECT user_id, task_id, "
        + ", ".join([_act("interruptions_today", "count(*)", "interruptions", "start_time", "24 HOUR"), _act("avg_interruption_s", "round(avg(duration_seconds), 6)", "interruptions", "start_time"), _act("recent_context_switches", "count(*)", "rs", "event_time", "7 DAY"), _act("recovery_time_s", "round(avg(x), 6)", "rc", "r"), _act("avg_session_7d_s", "round(avg(focused_time_seconds), 6)", "ms", "session_start", "7 DAY"), _act("switch_rate_7d", "round(avg(context_switch_count), 6)", "ms", "session_start", "7 DAY"), _act("fr", "avg(lost)", "rst", "t", "7 DAY"), _act("ni", "count(*)", "interruptions", "start_time", "7 DAY"), _act("hh", "sum(focused_time_seconds) / 3600.0", "ms", "session_start", "7 DAY")])
        + " FROM pt) SELECT * EXCLUDE (ni, hh, fr), round(least(1, coalesce(ni / nullif(hh, 0), 0) / 6), 6) AS interruption_load, round(0.6 * fr + 0.4 * least(1, coalesce(ni / nullif(hh, 0), 0) / 6), 6) AS daily_friction_score FROM a", "task_events", "interruptions"),
    **{n: with_views(f"SELECT {k}, count(*) AS tasks, count(*) FILTER (status = 'forgotten') AS forgotten, round(count(*) FILTER (status = 'forgotten') / nullif(count(*) FILTER (status IN ('completed', 'forgotten', 'cancelled')), 0)::DOUBLE, 6) AS forgetting_rate, count(DISTINCT category) AS categories FROM tasks WHERE created_at < TIMESTAMP '1998-01-01' GROUP BY {k}", "tasks") for n, k in (("f21_location_features", "location_id"),)},
    "f20_user_features": with_views(f"""WITH {S}, {ST}, t AS (SELECT user_id, round(count(*) FILTER (status = 'completed') / nullif(count(*) FILTER (status IN ('completed', 'forgotten', 'cancelled')), 0)::DOUBLE, 6) AS completion_rate, round(count(*) FILTER (status = 'forgotten') / nullif(count(*) FILTER (status IN ('completed', 'forgotten', 'cancelled')), 0)::DOUBLE, 6) AS forgetting_rate, count(*) AS n FROM st WHERE created_at < TIMESTAMP '2024-01-15' GROUP BY user_id),
      i AS (SELECT user_id, count(*) AS n, round(avg(duration_seconds), 6) AS a FROM ci WHERE start_time < TIMESTAMP '2024-01-15' GROUP BY user_id), s AS (SELECT user_id, round(avg(focused_time_seconds), 6) AS a, CAST(sum(context_switch_count) AS BIGINT) AS n FROM ms WHERE session_start < TIMESTAMP '2024-01-15' GROUP BY user_id)
      SELECT user_id, completion_rate, forgetting_rate, coalesce(t.n, 0) AS total_tasks, coalesce(i.n, 0) AS total_interruptions, i.a AS avg_interruption_s, s.a AS avg_session_s, coalesce(s.n, 0) AS total_context_switches FROM t FULL JOIN i USING (user_id) FULL JOIN s USING (user_id)""", "task_events", "interruptions"),
    "f22_online_features": with_views(f"""WITH {STC}, x AS (SELECT task_id, weekday, hour, deadline_hours, pc, pf, same, td, itd, sw, ses FROM (SELECT a.task_id, CAST(isodow(a.created_at) - 1 AS INT) AS weekday, CAST(hour(a.created_at) AS INT) AS hour, round(coalesce(greatest(0, (epoch_us(a.deadline_at) - epoch_us(a.created_at)) / 3.6e9), 72), 6) AS deadline_hours,
       (SELECT count(*) FROM et b WHERE b.user_id = a.user_id AND b.created_at < a.created_at AND b.created_at >= a.created_at - INTERVAL 30 DAY AND status = 'completed') AS pc,
       (SELECT count(*) FROM et b WHERE b.user_id = a.user_id AND b.created_at < a.created_at AND b.created_at >= a.created_at - INTERVAL 30 DAY AND status = 'forgotten') AS pf,
       (SELECT count(*) FROM et b WHERE b.user_id = a.user_id AND b.created_at < a.created_at AND b.created_at >= a.created_at - INTERVAL 30 DAY AND b.category = a.category) AS same,
       (SELECT count(*) FROM et b WHERE b.user_id = a.user_id AND b.created_at < a.created_at AND b.created_at >= date_trunc('day', a.created_at)) AS td,
       (SELECT count(*) FROM ci b WHERE b.user_id = a.user_id AND b.start_time < a.created_at AND b.start_time >= date_trunc('day', a.created_at)) AS itd,
       (SELECT sum(context_switch_count) FROM ms b WHERE b.user_id = a.user_id AND b.session_start < a.created_at AND b.session_start >= a.created_at - INTERVAL 6 HOUR) AS sw,
       (SELECT list(struct_pack(f := focused_time_seconds, i := interruption_time_seconds, k := interruption_count) ORDER BY session_start DESC, session_id DESC) FROM ms b WHERE b.user_id = a.user_id AND b.session_start < a.created_at)[1:30] AS ses FROM et a))
      SELECT task_id, weekday, hour, deadline_hours, pc AS previous_completion_count, pf AS previous_forgetting_count, round(coalesce(pc / nullif(pc + pf, 0)::DOUBLE, 0.6), 6) AS completion_rate, round(coalesce(pf / nullif(pc + pf, 0)::DOUBLE, 0.2), 6) AS forgetting_rate, round(coalesce(least(1, same / nullif(pc + pf, 0)::DOUBLE), 0), 6) AS task_frequency, td AS tasks_today, itd AS interruptions_today, CAST(coalesce(sw, 0) AS BIGINT) AS recent_context_switches,
      round(coalesce(list_avg(list_transform(list_filter(ses, lambda v: v.f > 0), lambda v: v.f)) / 60, 20), 6) AS avg_session_minutes, round(CASE WHEN ses IS NULL THEN 10 ELSE list_sum(list_transform(ses, lambda v: v.i)) / greatest(1, list_sum(list_transform(ses, lambda v: v.k))) / 60 END, 6) AS avg_interruption_minutes FROM x""", "task_events", "interruptions"),
    "l1_temporal_split": with_views("SELECT task_id, CASE WHEN row_number() OVER (ORDER BY created_at, task_id) <= floor(count(*) OVER () * 0.8) THEN 'train' ELSE 'test' END AS split FROM tasks", "tasks"),
    "l2_chronological_split": with_views(f"WITH {_CHR} SELECT task_id, split FROM spl", "tasks"),
    "l3_split_audit": with_views(f"WITH {_CHR}, m AS (SELECT split, min(CAST(created_at AS DATE)) AS a, max(CAST(created_at AS DATE)) AS b FROM spl GROUP BY split) SELECT (SELECT b FROM m WHERE split = 'train') < (SELECT a FROM m WHERE split = 'val') AS train_before_val, (SELECT b FROM m WHERE split = 'val') < (SELECT a FROM m WHERE split = 'test') AS val_before_test, (SELECT count(*) FROM (SELECT user_id FROM spl GROUP BY user_id HAVING count(DISTINCT split) > 1)) AS shared_users", "tasks"),
    "l4_split_summary": with_views(f"WITH {_CHR} SELECT split, count(*) AS rows, count(DISTINCT user_id) AS users, min(CAST(created_at AS DATE)) AS first, max(CAST(created_at AS DATE)) AS last, round(avg(CASE WHEN status = 'forgotten' THEN 1 ELSE 0 END), 6) AS rate FROM spl GROUP BY split", "tasks"),
    "l5_walk_forward": with_views(f"WITH {_DAYS}, f AS (SELECT CAST(fold AS INT) AS fold, day, CASE WHEN k - 1 < fold * (n // 6) THEN 'train' WHEN k - 1 < CASE WHEN fold = 5 THEN n ELSE (fold + 1) * (n // 6) END THEN 'test' END AS role FROM days, range(1, 6) AS r(fold)) SELECT fold, role, count(*) AS days, min(day) AS first, max(day) AS last FROM f WHERE role IS NOT NULL GROUP BY ALL", "tasks"),
    "l8_majority": with_views(f"WITH {_SC} SELECT CASE WHEN avg(y) > 0.5 THEN 1 ELSE 0 END AS label, round(avg(y), 6) AS rate FROM sc", "tasks"),
    "l12_confusion": with_views(f"WITH {_SC}, m AS (SELECT count(*) FILTER (p >= 0.5 AND y = 1) AS tp, count(*) FILTER (p >= 0.5 AND y = 0) AS fp, count(*) FILTER (p < 0.5 AND y = 1) AS fn, count(*) FILTER (p < 0.5 AND y = 0) AS tn FROM sc) SELECT {_CONF} FROM m", "tasks"),
    "l13_ranking_quality": with_views(f"WITH {_SC}, {_rq('')} SELECT * FROM q", "tasks"),
    "l14_threshold": with_views(f"WITH {_SC}, th AS (SELECT t, (SELECT count(*) FROM sc WHERE floor(round(p * 200, 6)) >= t AND y = 1) AS tp, (SELECT count(*) FROM sc WHERE floor(round(p * 200, 6)) >= t) AS yes, (SELECT sum(y) FROM sc) AS pp FROM range(10, 191) AS r(t)), f AS (SELECT t, round(2 * tp / (yes + pp), 6) AS f1 FROM th) SELECT arg_max(t / 200, (f1, -t)) AS threshold, max(f1) AS f1 FROM f", "tasks"),
    "l16_best_model": with_views(f"WITH {_TWO.format(_CHR, '')}, {_EVAL(_STACK.format('', _VAL), 'model')} SELECT arg_max(model, (average_precision, roc_auc, f1, model)) AS model FROM ev", "tasks"),
    **{f"l14_threshold_{m}": with_views(f"WITH {_SC}, th AS (SELECT t, (SELECT count(*) FROM sc WHERE floor(round(p * 200, 6)) >= t AND y = 1) AS tp, (SELECT count(*) FROM sc WHERE floor(round(p * 200, 6)) >= t) AS yes, (SELECT sum(y) FROM sc) AS pp, (SELECT count(*) FROM sc) AS n FROM range(10, 191) AS r(t)), f AS (SELECT t, round({v}, 6) AS v FROM th) SELECT arg_max(t / 200, (v, -t)) AS threshold, max(v) AS {m} FROM f", "tasks") for m, v in (("recall", "coalesce(tp / nullif(pp, 0), 0)"), ("precision", "coalesce(tp / nullif(yes, 0)::DOUBLE, 0)"), ("accuracy", "(2 * tp + n - yes - pp) / n"))},
    "l15_cross_validation": with_views(f"WITH {_DAYS}, {_SC}, f AS (SELECT fold, day FROM days, range(1, 6) AS r(fold) WHERE k - 1 >= fold * (n // 6) AND k - 1 < CASE WHEN fold = 5 THEN n ELSE (fold + 1) * (n // 6) END), {_EVAL('SELECT y, p::DOUBLE AS s, fold FROM sc JOIN f ON CAST(created_at AS DATE) = day', 'fold')}, u AS (UNPIVOT (SELECT roc_auc, average_precision, brier, f1 FROM ev) ON roc_auc, average_precision, brier, f1 INTO NAME metric VALUE v) SELECT metric, count(v) AS folds, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, min(v) AS low, max(v) AS high FROM u GROUP BY metric", "tasks"),
    "l7_preprocess": with_views("WITH t AS (SELECT task_id, CASE WHEN task_id % 3 > 0 THEN category END AS category, CASE WHEN task_id % 4 > 0 THEN priority::DOUBLE END AS priority FROM tasks) SELECT task_id, coalesce(category, (SELECT category FROM t WHERE category IS NOT NULL GROUP BY category ORDER BY count(*) DESC, category LIMIT 1)) AS category, coalesce(priority, (SELECT quantile_disc(priority, 0.5) FROM t)) AS priority FROM t", "tasks"),
    "q7_completeness": with_views(f"WITH ft AS ({_FSQL}), r AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, count({c}) / count(*)::DOUBLE AS v FROM ft" for c in FEATURES[:-3]) + ") SELECT feature, round(v, 6) AS completeness, round(avg(v) OVER (), 6) AS mean_completeness, v < 0.9 AS is_low FROM r", "tasks"),
    "l18_calibration_error": with_views(f"WITH {_SC}, e AS (SELECT quantile_cont(p::DOUBLE, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM sc), b AS (SELECT p, y, len(list_filter(e, lambda x: p::DOUBLE > x)) AS bin FROM sc, e), g AS (SELECT count(*) AS n, avg(p) AS m, avg(y) AS y FROM b GROUP BY bin) SELECT round(sum(n * abs(m - y)) / sum(n), 6) AS ece FROM g", "tasks"),
    "l19_segments_by_category": with_views(f"WITH {_SC}, {_rq('category')} SELECT * FROM q", "tasks"),
    "l19_segments": with_views(f"WITH {_TWO.format(_CHR, '')}, sg AS (SELECT *, 'urgent' AS segment FROM sp WHERE priority >= 4 UNION ALL SELECT *, 'late_night' FROM sp WHERE hour(created_at) >= 21 UNION ALL SELECT *, 'rare' FROM sp WHERE task_id % 997 = 0), {_EVAL(_STACK.format(', segment', 'sg'), 'segment, model')} SELECT * FROM ev WHERE rows >= 10", "tasks"),
    "l20_pairwise": with_views(f"WITH {_TWO.format(_CHR, '')}, {_EVAL(_STACK.format('', _VAL), 'model')} SELECT a.model AS model_a, b.model AS model_b, round(a.roc_auc - b.roc_auc, 5) AS difference, round((a.roc_auc - b.roc_auc) / b.roc_auc * 100, 3) AS percent_improvement, CASE WHEN a.roc_auc > b.roc_auc THEN a.model ELSE b.model END AS better FROM ev a JOIN ev b ON a.model < b.model", "tasks"),
    "l21_risk_bands": with_views(f"WITH {_SC} SELECT task_id, CASE WHEN p < 0.33 THEN 'LOW' WHEN p < 0.66 THEN 'MEDIUM' ELSE 'HIGH' END AS band FROM sc", "tasks"),
    "l23_importance": "WITH m AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}" for c in WEIGHTS) + " FROM lineitem) " + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(avg(abs({w} * ({c} - m_{c}))), 6) AS importance FROM lineitem, m" for c, w in WEIGHTS.items()),
    "l24_precision_at": "WITH g AS (SELECT l_orderkey, list_sort(list(DISTINCT l_partkey))[1:3] AS top, list(DISTINCT l_partkey) FILTER (l_quantity > 25) AS rel FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey, round(coalesce(len(list_intersect(top, coalesce(rel, []))) / nullif(len(top), 0)::DOUBLE, 0), 6) AS precision, round(coalesce(len(list_intersect(top, coalesce(rel, []))) / nullif(len(rel), 0)::DOUBLE, 0), 6) AS recall FROM g",
}
SQL["k8_features_of_buckets"] = SQL["f_task_features_in_chunks"] = SQL["f_task_features"]
SQL["f_resolved_asof_in_chunks"] = SQL["f_resolved_asof"]
SQL["f_activity_in_chunks"] = SQL["f_activity_features"]
