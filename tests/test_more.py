"""Cases with known answers for model fits, splits, rules, streams and sources, and every query over empty tables."""

import datetime as dt
import random
from itertools import combinations

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tideline.operators import associate, clean, features, learn, metrics, patterns, stats
from tideline.plans import registry
from tideline.sources import tables
from tideline.streaming import streams

T0 = dt.datetime(2024, 3, 1, 9, 0)
AT = lambda minutes: T0 + dt.timedelta(minutes=minutes)
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FITS = {"l9_logistic", "l10_forest", "l11_boosted", "l15_cross_validated_fits", "l16_fitted_and_chosen", "l17_calibrated", "l17_best_calibration", "l23_model_importance", "k9_batch_scores", "l7_preprocess", "p3_clusters", "p6_all_patterns"}


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("empty")
    for t in TABLES:
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{at}/{t}.parquet")
    return str(at)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - FITS))
def test_empty_tables(spark, empty, name):
    registry.QUERIES[name](spark, empty).collect()  # models can't be fitted on nothing


def labelled(spark, n=400):
    rng = random.Random(1)
    rows = [(i, float(i % 2) + rng.gauss(0, 0.2), rng.choice("ab") if i % 7 else None, None if i % 11 == 0 else rng.random(), i % 2, dt.date(2024, 1, 1) + dt.timedelta(days=i // 10)) for i in range(n)]
    return spark.createDataFrame(rows, "id long, x double, c string, z double, y int, day date")


@pytest.mark.parametrize("model", ["logistic", "forest", "boosted"])
def test_fits_separate_what_can_be_separated(spark, model):
    d = labelled(spark)
    q = learn.evaluate(learn.score(learn.fit(d, ["c"], ["x", "z"], "y", model), d), "y", "p").first()
    assert q.roc_auc > 0.97 and q.f1 > 0.9 and q.rows == 400


def test_fits_in_a_session_that_has_had_an_observation(spark):
    seen = Observation("rows")
    spark.range(3).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get == {"n": 3}
    d = labelled(spark)
    for model in ("logistic", "forest", "boosted"):
        m = learn.fit(d, ["c"], ["x", "z"], "y", model)
        assert learn.evaluate(learn.score(m, d), "y", "p").first().roc_auc > 0.97, model
    folds = learn.cross_validate(d, "day", "y", lambda train, test: learn.score(learn.fit(train, ["c"], ["x", "z"], "y"), test), 2)
    assert {r.folds for r in learn.cv_summary(folds).collect()} == {2}
    p = d.withColumn("p", F.least(F.greatest("x", F.lit(0.0)), F.lit(1.0)))
    assert learn.calibrate(p, "y", "p", p).where("p_sigmoid BETWEEN 0 AND 1").count() == 400
    assert learn.best_calibration(p, "y", "p").count() == 3


def test_cross_validation_and_choice(spark):
    d = labelled(spark)
    folds = learn.cross_validate(d, "day", "y", lambda train, test: test.withColumn("p", F.least(F.greatest("x", F.lit(0.0)), F.lit(1.0))), 3).collect()
    assert [r.fold for r in folds] == [1, 2, 3] and all(r.rows == 100 and r.roc_auc > 0.97 for r in folds)
    m = spark.createDataFrame([("a", 0.5, 0.9, 0.1), ("b", 0.5, 0.9, 0.2), ("c", 0.4, 1.0, 0.9)], "model string, average_precision double, roc_auc double, f1 double")
    assert learn.select_model(m).first().model == "b"
    got = {r.model_a + r.model_b: r for r in learn.compare_models(m, "average_precision").collect()}
    assert got["ac"].percent_improvement == 25.0 and got["ac"].better == "a"


def test_imputation(spark):
    d = spark.createDataFrame([(1, "b", 1.0), (2, "b", 3.0), (3, "a", None), (4, None, 5.0), (5, "a", 3.0)], "id long, c string, x double")
    assert learn.modes(d, ["c"]) == {"c": "a"}  # the smaller of equally common ones
    from pyspark.ml import Pipeline

    got = {r.id: r for r in Pipeline(stages=learn.preprocess(d, ["c"], ["x"])).fit(d).transform(d).collect()}
    assert got[4].c_f == "a" and got[3].x_i == 3.0


def test_ranking_quality_is_that_of_the_scores_themselves(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(2), rng.choice([rng.random(), 0.5, 0.50001])) for _ in range(300)]
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    got = learn.ranking_quality(spark.createDataFrame(rows, "y int, p double"), "y", "p").first()
    assert got.roc_auc == round(auc, 6)


def test_splits_keep_undated_rows(spark):
    d = spark.createDataFrame([(i, AT(i) if i % 4 else None) for i in range(20)] + [(100 + i, AT(7)) for i in range(5)], "id long, t timestamp")
    got = learn.temporal_split(d, "t", "id").collect()
    assert len(got) == 25
    dated = sorted((r.t, r.id) for r in got if r.t)
    assert {(r.t, r.id) for r in got if r.split == "train"} == set(dated[: int(len(dated) * 0.8)])
    assert {r.id for r in got if r.split == "undated"} == {0, 4, 8, 12, 16}
    assert learn.chronological_split(d, "t").where("split = 'undated'").count() == 5


def test_rules_of_every_size(spark):
    items = [f"i{k}" for k in range(5)]
    sets = [(list(c), 3) for n in range(1, 6) for c in combinations(items, n)]
    got = associate.rules(spark.createDataFrame(sets, "itemset array<string>, freq long"), 4, 0.0).collect()
    assert sum(len(r.antecedents) + len(r.consequents) == 5 for r in got) == 2**5 - 2
    assert all(r.confidence == 1.0 and r.conviction is None and r.lift == round(4 / 3, 6) for r in got)


def test_recommendations_need_all_antecedents_or_none(spark):
    rules = spark.createDataFrame(
        [(["a", "b"], ["c"], 0.3, 0.9, 2.0, 0.9), (["a"], ["d"], 0.3, 0.8, 1.5, 0.8), ([], ["e"], 0.7, 0.7, 1.0, 0.7), ([], ["c"], 0.2, 0.2, 1.0, 0.2), (["a"], ["a2", "b"], 0.3, 0.1, 1.1, None)],
        "antecedents array<string>, consequents array<string>, support double, confidence double, lift double, weighted_confidence double",
    )
    visits = spark.createDataFrame([(1, ["a", "b"]), (2, ["a"]), (3, ["x"]), (4, [])], "visit_id long, done array<string>")
    got = {}
    for r in sorted(associate.recommend(rules, visits, 0.0, 0.0, 0.0).collect(), key=lambda r: (r.visit_id, r.position)):
        got.setdefault(r.visit_id, []).append(r.task)
    assert {k: got[k] for k in (1, 3, 4)} == {1: ["c", "d", "e", "a2"], 3: ["e", "c"], 4: ["e", "c"]}
    assert got[2][:3] == ["d", "e", "c"] and set(got[2][3:]) == {"a2", "b"}
    few = associate.recommend(rules, visits, 0.0, 0.0, 0.0, top=1).where("visit_id = 1").collect()
    assert [r.task for r in few] == ["c"]


def test_dismissals_start_the_cooldown_anew(spark):
    rows = [(1, 0, False), (2, 100, False), (3, 3000, True), (4, 3650, False), (5, 6599, False), (6, 20000, False)]
    d = spark.createDataFrame([(i, 1, 1, t, x) for i, t, x in rows], "id long, user_id long, task_id long, t long, dismissed boolean")
    got = {r.id: r.hidden for r in associate.suppressed(d).collect()}
    until, want = -1, {}
    for i, t, dismissed in rows:
        want[i] = t < until
        until = t + 3600 if dismissed else max(until, t + 3600)
    assert got == want


def test_long_numbers_are_checked(spark):
    d = spark.createDataFrame([("99999999999999999", [1.0]), ("about 3.14159265", [3.0]), ("0, 1 and 2", [9.0]), ("50 %", [0.5])], "text string, payload array<double>")
    assert [r.faithful for r in associate.unfaithful_numbers(d, "text", "payload").collect()] == [False, True, True, True]


def test_rates_count_from_resolution(spark):
    rows = [(1, 1, "forgotten", AT(0), None, AT(10_000), None), (2, 1, "completed", AT(1), AT(2), None, None), (3, 1, "started", AT(5), None, None, None), (4, 1, "cancelled", AT(6), None, None, None), (5, 1, "started", AT(20_000), None, None, None)]
    d = spark.createDataFrame(rows, "task_id long, user_id long, status string, created_at timestamp, completed_at timestamp, forgotten_at timestamp, cancelled_at timestamp")
    got = {r.task_id: r.forgetting_rate_asof for r in features.resolved_asof_rate(d).collect()}
    assert got == {1: None, 2: None, 3: 0.0, 4: 0.0, 5: 0.5}


def test_quantiles_and_ranks(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, round(rng.random(), 2), 7.0])) for _ in range(500)]
    d = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: (r.q, r.h) for r in stats.quantiles(d, "v", {"q": 0.3, "h": 0.5}, "k").collect()}
    import numpy as np

    for k in ("a", "b", None):
        x = [v for kk, v in rows if kk == k and v is not None]
        assert np.allclose(got[k], [np.quantile(x, 0.3), np.quantile(x, 0.5)])
    ranked = stats.percentile_rank(d.where("v IS NOT NULL"), "v", "k").collect()
    for r in ranked[:50]:
        x = [v for kk, v in rows if kk == r.k and v is not None]
        assert r.rank == pytest.approx(100 * sum(v < r.v for v in x) / len(x), abs=1e-5)


def test_times_from_text(spark):
    d = spark.createDataFrame([(1, "2024-03-01 09:00:00"), (2, "nonsense"), (3, None)], "id long, t string")
    assert [r.t for r in clean.to_utc(d, ["t"]).orderBy("id").collect()] == [T0, None, None]


def test_category_aliases(spark):
    d = spark.createDataFrame([(" Deep Work ",), ("EMAIL",), ("e-mail",), (None,)], "category string")
    got = clean.normalise_category(d, {"deep work": "deep_work", "e-mail": "email"}).collect()
    assert [(r.category, r.category_changed) for r in got] == [("deep_work", True), ("email", False), ("email", True), (None, False)]


def run_stream(spark, tmp_path, parts, op, schema, mode="append"):
    out = []
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q = op(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")).writeStream.outputMode(mode).foreachBatch(lambda d, _: out.extend(d.collect())).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    return out


EVENTS = "id long, user_id long, task_id long, event_type string, event_time timestamp"


def test_streamed_sessions_end_at_the_idle_time(spark, tmp_path):
    parts = [[(1, 1, 1, "started", AT(0)), (2, 1, 2, "started", AT(1)), (3, 1, 2, "completed", AT(11))], [(9, 9, 9, "started", AT(600))], [(10, 9, 10, "paused", AT(601))]]
    got = run_stream(spark, tmp_path, parts, streams.lifecycle_sessions, EVENTS)
    assert {(r.session_id, r.session_start, r.session_end) for r in got if r.session_id < 9} == {(2, AT(1), AT(11)), (1, AT(0), AT(30))}


def test_streamed_status_in_any_order(spark, tmp_path):
    parts = [[(2, 1, 1, "paused", AT(50))], [(1, 1, 1, "started", AT(40)), (3, 1, 1, "created", AT(45))]]
    got = run_stream(spark, tmp_path, parts, streams.latest_status, EVENTS, "update")
    last = got[-1]
    assert (last.task_id, last.status, last.status_at, last.started_at) == (1, "paused", AT(50), AT(40))


def test_streamed_visits(spark, tmp_path):
    schema = "user_id long, task_id long, context long, ts timestamp, event_type string"
    parts = [[(1, 5, 1, AT(0), "COMPLETE"), (1, 6, 1, AT(60), "COMPLETE"), (1, 7, 1, AT(121), "COMPLETE"), (1, 8, 1, AT(1), "START")], [(2, 1, 1, AT(900), "COMPLETE")], [(2, 1, 1, AT(901), "COMPLETE")]]
    got = run_stream(spark, tmp_path, parts, streams.visit_sessions, schema)
    assert {(r.visit_start, tuple(r.tasks)) for r in got if r.user_id == 1} == {(AT(0), (5, 6)), (AT(121), (7,))}


def test_reads_and_streams_of_events(spark, tmp_path):
    d = spark.createDataFrame([(1, 2, 3, "started", AT(0)), (2, 2, 3, "paused", AT(60))], EVENTS)
    d.write.parquet(f"{tmp_path}/e")
    assert [r.id for r in tables.read_events(spark, f"{tmp_path}/e", str(AT(30))).collect()] == [2]
    assert tables.read_events(spark, f"{tmp_path}/e", schema=EVENTS).isStreaming


def test_clusters_and_anomalies_find_the_odd_session(spark):
    rows = [(i, 1, 1, 100.0 + i % 3, 90.0, 1.0, 1, 0, [1.0]) for i in range(60)] + [(99, 1, 1, 90000.0, 10.0, 80000.0, 60, 40, [9000.0])]
    d = spark.createDataFrame(rows, "user_id long, task_id long, seq long, session_duration_seconds double, focused_time_seconds double, interruption_time_seconds double, num_interruptions long, num_context_switches long, resume_delays_seconds array<double>")
    top = patterns.anomalies(d).orderBy(F.desc("score")).first()
    assert top.user_id == 99
    got = patterns.clusters(d, 2).orderBy("n").collect()
    assert [r.n for r in got] == [1, 60] and got[0].label == "interrupted" and got[1].share == round(60 / 61, 6)


def test_daily_friction_and_trend(spark):
    daily = spark.createDataFrame([(1, dt.date(2024, 1, d), 10.0 * d) for d in range(1, 5)] + [(2, dt.date(2024, 1, 1), 5.0), (3, dt.date(2024, 1, 1), 5.0), (3, dt.date(2024, 1, 2), 5.0)], "user_id long, period_start date, friction double")
    (r,) = associate.friction_trend(daily).collect()
    assert (r.user_id, r.insight, r.slope, r.points, r.first, r.last) == (1, "increasing_friction", 10.0, 4, 10.0, 40.0)


def test_reliability_by_day_of_completion(spark):
    rows = [(1, "completed", AT(0), AT(60)), (1, "completed", AT(0), AT(3000)), (2, "completed", AT(0), AT(60)), (3, "forgotten", AT(0), None)]
    d = spark.createDataFrame(rows, "user_id long, status string, created_at timestamp, completed_at timestamp")
    got = {r.user_id: r.reliability for r in metrics.reliability(d, str(AT(4000))).collect()}
    assert got == {1: 1.0, 2: 0.5, 3: 0.5}
