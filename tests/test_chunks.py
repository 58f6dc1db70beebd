import random

from pyspark.sql import functions as F

from tideline.operators import features

SCHEMA = "task_id long, user_id long, category string, location_id long, status string, created_at timestamp, completed_at timestamp, forgotten_at timestamp, cancelled_at timestamp, deadline_at timestamp"


def tasks(spark, seed=3, n=400):
    """Half of all rows are user 1's; some instants repeat, any column may be null."""
    r = random.Random(seed)
    at = "timestamp_seconds({}) AS {}"
    rows = []
    for i in range(n):
        t = 1_700_000_000 + r.choice([r.randrange(40 * 86400), 3600 * r.randrange(900), 86400 * 7])
        some = lambda x: None if r.random() < 0.05 else x
        status = some(r.choice(["completed", "forgotten", "forgotten", "pending", "cancelled"]))
        end = {k: t + r.randrange(90000) if status == k else None for k in ("completed", "forgotten", "cancelled")}
        rows.append((i, some(1 if i % 2 else r.randrange(2, 12)), some(r.choice("abc")), some(r.randrange(3)), status, some(t), *end.values(), t + 7200))
    raw = spark.createDataFrame(rows, "task_id long, user_id long, category string, location_id long, status string, t long, c long, f long, x long, d long")
    return raw.selectExpr("task_id", "user_id", "category", "location_id", "status", *[at.format(a, b) for a, b in (("t", "created_at"), ("c", "completed_at"), ("f", "forgotten_at"), ("x", "cancelled_at"), ("d", "deadline_at"))])


def same(a, b):
    assert a.columns == b.columns
    rows = lambda d: sorted(map(str, d.collect()))
    x, y = rows(a), rows(b)
    assert x == y and x


def test_chunks_are_in_time_order_and_halos_reach_back(spark):
    t = tasks(spark).withColumn("_t", F.unix_micros("created_at"))
    got = features.in_chunks(t, 20, features.DAY).where("user_id = 1").toPandas()
    own = got[~got["_halo"]]
    assert own["task_id"].is_unique and len(own) == t.where("user_id = 1").count()
    assert own["_chunk"].nunique() >= 8 and set(own["_chunk"]) == set(range(own["_end"].max() + 1))
    spans = own.groupby("_chunk")["_t"].agg(["min", "max"])
    assert (spans["min"].iloc[1:].to_numpy() > spans["max"].iloc[:-1].to_numpy()).all()
    for c, low in spans["min"].iloc[1:].items():
        want = set(own[(own["_t"] < low) & (own["_t"] >= low - features.DAY)]["task_id"])
        assert want <= set(got[got["_halo"] & (got["_chunk"] == c)]["task_id"])


def test_task_features_of_split_users(spark):
    t = tasks(spark)
    for chunk in (1, 7, 20, 150, 10_000):
        same(features.task_features(t, chunk), features.task_features(t))
    assert features.task_features(t.limit(0), 5).count() == 0


def test_resolved_rates_of_split_users(spark):
    t = tasks(spark)
    for chunk in (1, 20, 10_000):
        same(features.resolved_asof_rate(t, chunk), features.resolved_asof_rate(t))


def test_activity_of_split_users(spark):
    t = tasks(spark)
    points = t.where("created_at IS NOT NULL").select("user_id", "task_id", "created_at")
    seconds = F.when(F.col("task_id") % 9 > 0, (F.col("task_id") * 37 % 600).cast("int"))
    interruptions = t.select("user_id", F.col("created_at").alias("start_time"), seconds.alias("duration_seconds"))
    kinds = F.element_at(F.array(*map(F.lit, ("paused", "resumed", "created"))), (F.col("task_id") % 3 + 1).cast("int"))
    events = t.select("user_id", (F.col("task_id") % 30).alias("task_id"), F.col("task_id").alias("id"), kinds.alias("event_type"), F.col("created_at").alias("event_time"))
    sessions = t.select("user_id", F.col("created_at").alias("session_start"), seconds.alias("focused_time_seconds"), (F.col("task_id") % 5).alias("context_switch_count"))
    for chunk in (40, 200, 100_000):
        same(features.activity_features(points, events, interruptions, sessions, t, chunk=chunk), features.activity_features(points, events, interruptions, sessions, t))
