"""Rules and recommendations in context, detectors and ranking, against plain loops."""

import random
from itertools import combinations

from pyspark.sql import functions as F
from tideline.operators import associate


def mined(baskets, support, confidence, lift):
    n, out = len(baskets), {}
    items = sorted({x for b in baskets for x in b})
    freq = {}
    for k in range(1, len(items) + 1):
        found = {s: sum(set(s) <= b for b in baskets) for s in combinations(items, k)}
        found = {s: f for s, f in found.items() if f and f >= support * n - 1e-9}
        if not found:
            break
        freq |= found
    for s, f in freq.items():
        for k in range(1, len(s)):
            for a in combinations(s, k):
                c = tuple(x for x in s if x not in a)
                conf = f / freq[a]
                if round(conf, 6) >= confidence and round(conf / (freq[c] / n), 6) >= lift:
                    out[a, c] = (round(f / n, 6), round(conf, 6), round(conf / (freq[c] / n), 6))
    return out


def test_rules_of_every_size_by_context(spark):
    r = random.Random(5)
    by = {"12:a": 40, "b": 3, "one": 1, "ü,c": 17, "d": 300}
    rows, baskets = [], {}
    for c, n in by.items():
        for k in range(n):
            b = {f"{i}" for i in range(6) if r.random() < 0.35 + 0.4 * (i < 3)} or {"0"}
            baskets.setdefault(c, []).append(b)
            rows += [(f"{c}/{k}", c, i) for i in b]
    rows.append(("none", None, "0"))
    d = spark.createDataFrame(rows, "basket_id string, context string, item string")
    got = {}
    for x in associate.context_rules(d, 0.1, 0.3, 1.0).collect():
        got.setdefault(x.context, {})[tuple(x.antecedents), tuple(x.consequents)] = (x.support, x.confidence, x.lift)
    want = {c: mined(b, 0.1, 0.3, 1.0) for c, b in baskets.items() if len(b) > 1}
    assert {c: set(v) for c, v in got.items()} == {c: set(v) for c, v in want.items() if v}
    assert all(abs(p - q) < 2e-6 for c in got for key in got[c] for p, q in zip(got[c][key], want[c][key]))
    assert any(len(a) + len(c) > 3 for v in got.values() for a, c in v)
    assert associate.context_rules(d.where("context = 'one'")).collect() == []


def test_recommendations_in_context(spark):
    r = random.Random(6)
    names, rules = [f"t{i}" for i in range(9)], []
    for c in "xyz":
        rules += [(c, [], [t], *[round(r.random(), 2) for _ in range(2)], 1.0, None) for t in r.sample(names, 7)]
        rules += [(c, sorted(r.sample(names, r.choice([1, 2]))), r.sample(names, 1), *[round(r.random(), 2) for _ in range(2)], round(0.8 + r.random(), 2), round(r.random() * 2, 2)) for _ in range(25)]
    rules = list({(x[0], tuple(x[1]), tuple(x[2])): x for x in rules if not set(x[1]) & set(x[2])}.values())
    visits = [(i, i % 4, r.choice("xyzw"), 100 * i, sorted(r.sample(names, r.randrange(4)))) for i in range(60)]
    marks = [(u, c, r.choice(names), t + r.choice([-50, 0, -900])) for _, u, c, t, _ in visits for _ in range(2)]
    f = spark.createDataFrame(rules, "context string, antecedents array<string>, consequents array<string>, support double, confidence double, lift double, weighted_confidence double")
    v = spark.createDataFrame(visits, "visit_id long, user_id long, context string, t long, done array<string>")
    m = spark.createDataFrame(marks, "user_id long, context string, task string, t long")
    hidden = associate.hidden_tasks(v, m, 1000)
    for limits in ((0.5, 0.05, 1.0), (0.0, 0.0, 0.0)):
        got = {}
        for x in associate.recommend(f, v, *limits, top=3, hidden=hidden).collect():
            got.setdefault(x.visit_id, {})[x.position] = x.task
        want = {}
        for i, u, c, t, done in visits:
            best = {}
            for c2, a, q, sup, conf, lift, w in rules:
                if c2 == c and conf >= limits[0] and sup >= limits[1] and lift >= limits[2] and set(a) <= set(done):
                    for task in set(q) - set(done):
                        key = (-lift, -(conf if w is None else w), ",".join(a))
                        best[task] = min(best.get(task, (key, sup)), (key, sup))
            off = {task for u2, c2, task, s in marks if (u2, c2) == (u, c) and s <= t < s + 1000}
            order = sorted((b[0][1], b[0][0], -b[1], task) for task, b in best.items() if task not in off)
            if order:
                want[i] = {k + 1: x[3] for k, x in enumerate(order[:3])}
        assert got == want and len(want) > 10


def test_detectors_and_ranking(spark):
    p = spark.createDataFrame([(1, 7, 3, 0.4, "LOW"), (1, 8, 12, 0.6, "LOW"), (2, 9, 0, 0.9, "LOW")], "user_id long, task_id long, forgotten long, probability double, risk_level string")
    c = spark.createDataFrame([(1, 5, 20.0, 30.0, None), (2, 10, 1.0, 90.0, "home")], "user_id long, switches long, interruption_minutes double, recovery_minutes double, affected_category string")
    a = spark.createDataFrame([(2, 9, 0.8, 1.3)], "user_id long, task_id long, confidence double, lift double")
    found = associate.detect(p, c, a)
    level = {(r.user_id, r.insight, r.subject): r.priority for r in found.collect()}
    assert level == {
        (1, "frequent_forgetting", "7"): "LOW", (1, "frequent_forgetting", "8"): "MEDIUM", (2, "high_risk", "9"): "HIGH", (1, "context_switching", "1"): "MEDIUM", (2, "context_switching", "2"): "HIGH",
        (1, "interruptions", "1"): "HIGH", (2, "affected_category", "home"): "MEDIUM", (2, "association", "9"): "MEDIUM",
    }
    score = {(r.user_id, r.insight, r.subject): (r.score, r.band) for r in associate.rank_insights(found).collect()}
    assert score[1, "frequent_forgetting", "8"] == (round(0.3 + 0.15 + 0.1 + 0.05 + 0.025, 6), "MEDIUM")
    assert score[1, "frequent_forgetting", "7"] == (round(0.09 + 0.1 + 0.1 + 0.05 + 0.025, 6), "MEDIUM")
    assert score[2, "context_switching", "2"] == (round(0.3 + 0.25 + 0.125 + 0.1, 6), "HIGH")
    assert score[1, "interruptions", "1"][1] == "MEDIUM"


def test_equal_visits_are_recommended_for_once(spark, monkeypatch):
    f = spark.createDataFrame([(["a"], ["b"], 0.5, 0.9, 2.0), (["a"], ["c"], 0.5, 0.8, 1.5), ([], ["d"], 0.4, 0.4, 1.0)], "antecedents array<string>, consequents array<string>, support double, confidence double, lift double").withColumn("weighted_confidence", F.col("confidence"))
    v = spark.createDataFrame([(i, ["a"] if i else ["a", "b"]) for i in range(40)], "visit_id long, done array<string>")
    made, stored = {}, associate.stored
    monkeypatch.setattr(associate, "stored", lambda d, name: made.setdefault(name, stored(d, name)))
    got = {(r.visit_id, r.position): r.task for r in associate.recommend(f, v, 0.0, 0.0, 0.0).collect()}
    assert got == {(i, k + 1): t for i in range(40) for k, t in enumerate("bcd" if i else "cd")}
    assert made["met"].count() == 3  # of two kinds of visits


def broadcasts(d):
    """What each broadcast of the plan holds, as text."""
    lines, out = d._jdf.queryExecution().executedPlan().toString().splitlines(), []
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    for i, x in enumerate(lines):
        if "BroadcastExchange" in x:
            below = next((j for j in range(i + 1, len(lines)) if depth(lines[j]) <= depth(x)), len(lines))
            out.append("\n".join(lines[i:below]))
    return out


def test_visits_are_not_broadcast_by_the_size_of_their_files(spark, monkeypatch):
    f = spark.createDataFrame([(["a"], ["b"], 0.5, 0.9, 2.0), (["a"], ["c"], 0.5, 0.8, 1.5), ([], ["d"], 0.4, 0.4, 1.0)], "antecedents array<string>, consequents array<string>, support double, confidence double, lift double").withColumn("weighted_confidence", F.col("confidence"))
    v = spark.createDataFrame([(i, ["a"] if i else ["a", "b"]) for i in range(40)], "visit_id long, done array<string>")
    v = associate.stored(v, "visits")  # of a few hundred bytes
    h = spark.createDataFrame([(3, "b")], "visit_id long, task string")
    made, stored = {}, associate.stored

    def spied(d, name):
        made[name] = d
        return stored(d, name)

    monkeypatch.setattr(associate, "stored", spied)
    for hidden in (None, h):
        want = {(i, k + 1): t for i in range(40) for k, t in enumerate("cd" if i == 0 or (hidden is not None and i == 3) else "bcd")}
        for few in (associate.FEW, 1):  # few rules are broadcast, others aren't
            monkeypatch.setattr(associate, "FEW", few)
            d = associate.recommend(f, v, 0.0, 0.0, 0.0, hidden=hidden)
            assert {(r.visit_id, r.position): r.task for r in d.collect()} == want
            assert len(broadcasts(made["met"])) == (few > 1)
            assert not [x for p in (made["met"], d) for x in broadcasts(p) if "visit_id" in x]
        monkeypatch.undo()
        monkeypatch.setattr(associate, "stored", spied)


def test_parts_are_not_broadcast_by_the_size_of_large_files(spark, monkeypatch):
    from tideline.plans import views
    from tideline.sources import tables

    sf = "/root/testdata/sf0.001"
    for n in ("baskets", "visits"):
        d = views.view(spark, sf, n)
        want = sorted(map(str, d.collect()))
        with monkeypatch.context() as m:
            m.setattr(views, "merged_if_large", lambda d, of: tables.merged_if_large(d, of, 1000))
            e = views.view(spark, sf, n)
        assert broadcasts(d) and not broadcasts(e) and sorted(map(str, e.collect())) == want


def test_visits_are_not_broadcast_to_rules_of_itemsets(spark, monkeypatch):
    f = spark.createDataFrame([(["a", "b"], ["c"], 0.5, 0.9, 2.0), (["a"], ["b"], 0.5, 0.8, 1.5)], "antecedents array<string>, consequents array<string>, support double, confidence double, lift double").withColumn("weighted_confidence", F.col("confidence"))
    f = f.union(spark.createDataFrame([([], ["a"], 0.4, 0.4, 1.0, 0.4)], f.schema))
    v = associate.stored(spark.createDataFrame([(i, ["a", "b"] if i % 2 else ["a"]) for i in range(40)], "visit_id long, done array<string>"), "visits")
    made, stored = {}, associate.stored
    monkeypatch.setattr(associate, "stored", lambda d, name: stored(made.setdefault(name, d), name))
    d = associate.recommend(f, v, 0.0, 0.0, 0.0)
    assert {(r.visit_id, r.task) for r in d.collect()} == {(i, "c" if i % 2 else "b") for i in range(40)}
    assert not [x for p in (made["met"], d) for x in broadcasts(p) if "visit_id" in x]
