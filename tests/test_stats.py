"""Kendall's tau-b against all pairs, counts observed while cleaned tables are written, and tables in buckets."""

import math
import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from tideline.operators import clean, features, sessions, stats
from tideline.plans import prepare
from tideline.plans.views import view
from tideline.sources import tables

SF = "/root/testdata/sf0.001"


def brute(rows):
    rows = [(x, y) for x, y in rows if x is not None and y is not None and not math.isnan(y)]
    score = tx = ty = 0
    for i, (a, b) in enumerate(rows):
        for c, d in rows[:i]:
            score += ((a > c) - (a < c)) * ((b > d) - (b < d))
            tx, ty = tx + (a != c), ty + (b != d)
    return round(score / math.sqrt(tx * ty), 6) if tx and ty else None


@pytest.mark.parametrize("ranges", [2, 5, 64])
@pytest.mark.parametrize("spread", [3, 40, 10**6])
def test_kendall_with_ties_and_nulls(spark, ranges, spread):
    rng = random.Random(spread)
    rows = [(rng.randrange(spread), rng.randrange(spread) / 7) for _ in range(250)]
    rows = [(x, y + x / 3 if rng.random() < 0.5 else y) for x, y in rows]
    rows += [(5, 1.0)] * 80 + [(None, 2.0), (2, None), (3, float("nan"))]  # a hot pair of values
    got = stats.kendall(spark.createDataFrame(rows, "a long, b double"), ["a", "b"], ranges).collect()
    assert [(r.a, r.b, r.r) for r in got] == [("a", "b", brute(rows))]


def test_kendall_of_constants_and_empty_tables(spark):
    for rows in ([], [(1, 2.0)], [(1, 2.0), (1, 3.0)], [(None, 2.0)]):
        assert [r.r for r in stats.kendall(spark.createDataFrame(rows, "a long, b double"), ["a", "b"]).collect()] == [None]
    far = [(2**53 + i, float(i)) for i in range(9)]  # longs that doubles would merge
    assert stats.kendall(spark.createDataFrame(far, "a long, b double"), ["a", "b"]).first().r == 1.0


def test_inversions():
    rng = np.random.default_rng(4)
    x, y, n = (rng.integers(0, 12, 200) for _ in range(3))
    want = sum(int(n[i] * n[j]) for i in range(200) for j in range(200) if x[i] < x[j] and y[i] > y[j])
    assert stats.inversions(x, y, n) == want
    assert stats.inversions(x[:0], y[:0], n[:0]) == 0


def test_counts_are_observed_in_the_pass_that_writes(spark, tmp_path):
    raw = prepare._dirty(spark, SF), view(spark, SF, "interruptions"), prepare._odd_tasks(spark, SF)
    got = tables.write_cleaned(*raw, prepare.ALIASES, str(tmp_path))
    want = clean.cleaning_report(*raw, prepare.ALIASES)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    for name, d in zip(("events", "interruptions", "tasks"), (clean.clean_events(raw[0]), clean.clean_interruptions(raw[1]), clean.clean_tasks(raw[2], prepare.ALIASES))):
        again = spark.read.parquet(f"{tmp_path}/{name}")
        assert again.count() == d.count() and again.exceptAll(d.select(again.columns)).isEmpty()


def test_nothing_to_observe(spark, tmp_path):
    raw = [d.limit(0) for d in (prepare._dirty(spark, SF), view(spark, SF, "interruptions"), prepare._odd_tasks(spark, SF))]
    assert {r.rows for r in tables.write_cleaned(*raw, prepare.ALIASES, str(tmp_path)).collect()} == {0}


def shuffles(d):
    return d._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.mark.parametrize("buckets", [3, 16])
def test_tables_in_buckets_need_no_shuffle(spark, buckets):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tasks, events, interruptions = (view(spark, SF, v) for v in ("tasks", "task_events", "interruptions"))
        users = tables.stored_by(tasks, "tasks", "user_id", "created_at", buckets=buckets)
        of_task = [tables.stored_by(d, "rows", "task_id", buckets=buckets) for d in (events, interruptions)]
        whole = lambda e, i: sessions.measured_sessions(sessions.lifecycle_sessions(e, "2030-01-01"), i)
        for d, want in ((features.task_features(users), features.task_features(tasks)), (sessions.lifecycle_sessions(of_task[0], "2030-01-01"), sessions.lifecycle_sessions(events, "2030-01-01")), (whole(*of_task), whole(events, interruptions))):
            assert shuffles(want) > shuffles(d)
            assert sorted(map(str, d.select(*sorted(d.columns)).collect())) == sorted(map(str, want.select(*sorted(d.columns)).collect()))
        assert shuffles(features.task_features(users)) == shuffles(sessions.lifecycle_sessions(of_task[0], "2030-01-01")) == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_buckets_of_nulls_and_nothing(spark):
    d = spark.createDataFrame([(None, 1), (7, 2), (7, None)], "user_id long, n int")
    for rows in (d, d.limit(0)):
        got = tables.stored_by(rows, "few", "user_id", buckets=4)
        assert sorted(map(str, got.collect())) == sorted(map(str, rows.collect()))
        assert shuffles(got.groupBy("user_id").agg(F.count("*"))) == 0


def test_cramers_v_of_many_million_rows(spark):
    # 12 million rows a cell on the diagonal: o * o * n leaves a long
    one = spark.range(24_000_000).select((F.col("id") % 2).alias("a"), (F.col("id") % 2).alias("b"))
    got = stats.cramers_v(one, "a", "b").first()
    assert (got.chi2, got.v, got.association) == (24_000_000.0, 1.0, "strong")


def test_tables_are_spread_by_the_size_of_their_files(spark, tmp_path):
    spark.range(1000).withColumn("v", F.rand(1)).repartition(3).write.parquet(f"{tmp_path}/d")
    d = spark.read.parquet(f"{tmp_path}/d")
    few, many = tables.spread_by(d, "id"), tables.spread_by(d, "id", each=1000)
    assert few is d and many.rdd.getNumPartitions() > 8 and many.count() == 1000
    plan = many.groupBy("id").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    small = d.limit(10).withColumnRenamed("id", "k")
    assert tables.spread_by(small, "k", of=d, each=1000).rdd.getNumPartitions() == many.rdd.getNumPartitions()


def test_baskets_and_features_of_large_tables_have_more_partitions(spark, monkeypatch):
    from tideline.plans import model, views

    spread = lambda d, *k, of=None: tables.spread_by(d, *k, of=of, each=10_000)
    want = {n: sorted(map(str, view(spark, SF, n).collect())) for n in ("baskets", "visits")}
    features = sorted(map(str, model.QUERIES["f_task_features"](spark, SF).collect()))
    monkeypatch.setattr(views, "spread_by", spread)
    monkeypatch.setattr(model, "spread_by", spread)
    for n, rows in want.items():
        d = view(spark, SF, n)
        assert sorted(map(str, d.collect())) == rows and "REPARTITION_BY_NUM" in d._jdf.queryExecution().executedPlan().toString()
    d = model.QUERIES["f_task_features"](spark, SF)
    assert sorted(map(str, d.collect())) == features and "REPARTITION_BY_NUM" in d._jdf.queryExecution().executedPlan().toString()
