"""Cases with known answers."""

import datetime as dt
import math
from itertools import combinations

from pyspark.sql import functions as F

from tideline.operators import associate, clean, features, learn, metrics, sessions
from tideline.sources import tables

T0 = dt.datetime(2024, 3, 1, 9, 0)
AT = lambda minutes: T0 + dt.timedelta(minutes=minutes)
EVENTS = "id long, user_id long, task_id long, location_id long, event_type string, event_time timestamp"
INTERRUPTIONS = "id long, user_id long, task_id long, interruption_type string, start_time timestamp, end_time timestamp, duration_seconds long"


def lifecycle(spark, rows, as_of="2024-03-02 00:00:00"):
    d = spark.createDataFrame([(i, 1, 1, 1, k, AT(m)) for i, (k, m) in enumerate(rows)], EVENTS)
    return sessions.lifecycle_sessions(d, as_of)


def test_sessions(spark):
    (one,) = lifecycle(spark, [("started", 0), ("completed", 30)]).collect()
    assert one.session_end == AT(30)
    two = sorted(lifecycle(spark, [("started", 0), ("paused", 20), ("resumed", 180), ("completed", 195)]).collect(), key=lambda r: r.session_start)
    assert [r.resume_delay_seconds for r in two] == [None, 9600.0]
    (idle,) = lifecycle(spark, [("started", 0)]).collect()
    assert idle.session_end == AT(30)
    assert lifecycle(spark, [("paused", 0), ("completed", 5)]).count() == 0
    assert lifecycle(spark, []).count() == 0


def test_interruptions_in_a_session(spark):
    s = lifecycle(spark, [("started", 0), ("completed", 60)])
    i = spark.createDataFrame([(1, 1, 1, "phone", AT(10), AT(18), 480), (2, 1, 1, "phone", AT(30), None, 10), (3, 1, None, "call", AT(5), AT(6), 60)], INTERRUPTIONS)
    (r,) = sessions.measured_sessions(s, i).collect()
    assert (r.context_switch_count, r.interruption_time_seconds, r.focused_time_seconds) == (1, 480, 3120)


def test_context_session(spark):
    kinds = [("START", 0), ("INTERRUPTION", 60), ("RESUME", 120), ("COMPLETE", 240)]
    d = spark.createDataFrame([(i, 1, 1, 0, 0, T0 + dt.timedelta(seconds=s), k) for i, (k, s) in enumerate(kinds)], "id long, user_id long, task_id long, task_category long, context long, ts timestamp, event_type string")
    (r,) = sessions.context_sessions(d).collect()
    assert (r.focused_time_seconds, r.interruption_time_seconds, r.num_interruptions, r.resume_delays_seconds) == (180.0, 60.0, 1, [60.0])


def test_cleaning_fills_and_keeps_case_variants(spark):
    i = spark.createDataFrame([(1, 1, 1, " Phone ", AT(0), AT(2), None), (2, 1, 1, "call", AT(0), None, 90), (3, 1, 1, "call", AT(0), None, 90)], INTERRUPTIONS)
    got = {r.id: r for r in clean.clean_interruptions(i).collect()}
    assert set(got) == {1, 2} and got[1].duration_seconds == 120 and got[1].interruption_type == "phone" and got[2].end_time == AT(1.5)
    e = spark.createDataFrame([(1, 1, 1, 1, "created", AT(0)), (2, 1, 1, 1, "CREATED", AT(0)), (3, 1, 1, 1, "created", AT(0))], EVENTS)
    assert clean.clean_events(e).count() == 2


def test_friction_of_forgetting_alone(spark):
    base = spark.createDataFrame([(1, 1.0, 3, 0, 0, 0, 0, None, 0)], "user_id long, forget double, tasks long, interruptions long, interruption_s long, sessions long, switches long, delay double, active_s long")
    assert metrics.friction(base).first().friction == 35.0


def test_asof_features_do_not_leak(spark):
    day = lambda d: dt.datetime(2024, 1, d)
    rows = [(1, 1, "email", 1, "forgotten", day(1), None), (2, 1, "email", 1, "completed", day(2), None), (3, 1, "email", 1, "forgotten", day(10), None), (4, 1, "email", None, "started", day(3), None), (5, 1, "email", 1, "started", day(3), None)]
    d = spark.createDataFrame(rows, "task_id long, user_id long, category string, location_id long, status string, created_at timestamp, deadline_at timestamp")
    r = {x.task_id: x for x in features.task_features(d).collect()}
    assert (r[4].task_frequency, r[4].previous_forgetting_count, r[4].previous_completion_count, r[4].forgetting_streak) == (2, 1, 1, 0)
    assert r[4].location_forgetting_rate is None and r[2].forgetting_streak == 1 and r[5].task_frequency == 2
    assert features.task_features(d.limit(0)).count() == 0


def test_rules(spark):
    sets = [["cf", "sr"]] * 30 + [["af", "cf", "sr"]] * 10 + [["cf"]] * 5 + [["pf"]] * 2
    d = spark.createDataFrame([(s,) for s in sets], "items array<string>")
    got = {(tuple(r.antecedents), tuple(r.consequents)): r for r in associate.rules(associate.itemsets(d, 0.1), len(sets), 0.0).collect()}
    r = got[("cf",), ("sr",)]
    assert abs(r.support - 40 / 47) < 1e-6 and abs(r.confidence - 40 / 45) < 1e-6
    assert ("af",) in {a for a, c in got if c == ("cf", "sr")}
    f = spark.createDataFrame([("x", a) for a in ["ACCEPTED"] * 3 + ["DEFERRED"]], "k string, action string")
    assert associate.acceptance_weights(f, "k").first().weight == 5.0


def test_rules_of_itemsets_of_every_size(spark):
    for k in (6, 13):
        items = [f"i{j:02}" for j in range(k)]
        sets = [(list(c), 5) for r in range(1, k + 1) for c in combinations(items, r)] if k == 6 else [(items, 5), *(([i], 5) for i in items), *((items[:j] + items[j + 1 :], 5) for j in range(k))]
        got = [(tuple(r.antecedents), tuple(r.consequents)) for r in associate.rules(spark.createDataFrame(sets, "itemset array<string>, freq long"), 5, 0.5).collect()]
        assert len(got) == len(set(got)) and all(sorted(a + c) == list(items) for a, c in got if len(a + c) == k)
        if k == 6:  # every set of m items has 2**m - 2 rules
            assert len(got) == sum(math.comb(6, m) * (2**m - 2) for m in range(2, 7))
        else:  # those whose sides are both among the sets
            assert len(got) == 2 * 13


def test_long_numbers_are_checked(spark):
    texts = ["it took 3.14159265 h", "order 12345678901234", "order 98765432109876543210", "it took 2.71828182 h", "2 of 7"]
    d = spark.createDataFrame([(i, t, [2.3, 0.07]) for i, t in enumerate(texts)], "i int, text string, payload array<double>")
    assert [r.unfaithful for r in associate.unfaithful_numbers(d, "text", "payload").orderBy("i").collect()] == [1, 1, 1, 0, 0]


def test_ranking_quality(spark):
    d = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.1)], "y int, p double")
    r = learn.ranking_quality(d, "y", "p").first()
    assert r.roc_auc == 0.75 and abs(r.average_precision - (0.5 + 0.5 * 2 / 3)) < 1e-5


def test_sources(spark, tmp_path):
    (tmp_path / "locations.csv").write_text("id,user_id,name,location_type\n1,2,home,HOME\n")
    for n in ("tasks", "task_events", "interruptions"):
        (tmp_path / f"{n}.csv").write_text(",".join(c.split()[0] for c in tables.CSV_SCHEMAS[n].split(", ")) + "\n")
    assert tables.read_csv_tables(spark, str(tmp_path))["locations"].first().name == "home"
    old = spark.createDataFrame([(1, 5.0, 1), (2, 6.0, 1)], "k int, value double, computed_at int")
    old.write.parquet(f"{tmp_path}/m")
    tables.upsert_metrics(spark.createDataFrame([(1, 7.0, 2)], old.schema), f"{tmp_path}/m", f"{tmp_path}/m2", ["k"])
    assert {r.k: r.value for r in spark.read.parquet(f"{tmp_path}/m2").collect()} == {1: 7.0, 2: 6.0}
    d = spark.createDataFrame([(1, 0, "train"), (2, 1, "test")], "task_id int, y int, split string")
    tables.export_dataset(d, f"{tmp_path}/out", "y", "task_id")
    assert spark.read.parquet(f"{tmp_path}/out/labels").where(F.col("split") == "test").first().y == 1
