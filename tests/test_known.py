"""Known answers for calibration choice, importances, batch scores with reasons, and pattern ids."""

import hashlib
import math
import random

from pyspark.sql import functions as F

from tideline.operators import learn, patterns


def scored(spark, wrong, n=600):
    """Scores whose true rates are 0.1, 0.5 and 0.9; ``wrong`` ones are off in no way that a sigmoid can mend."""
    rng = random.Random(3)
    shown = {0.1: 0.5, 0.5: 0.9, 0.9: 0.1} if wrong else {p: p for p in (0.1, 0.5, 0.9)}
    rows = [(i, shown[p], int(rng.random() < p)) for i in range(n) for p in [(0.1, 0.5, 0.9)[i % 3]]]
    return spark.createDataFrame(rows, "id long, p double, y int")


def brier(rows, c):
    return sum((r[c] - r.y) ** 2 for r in rows) / len(rows)


def test_the_best_calibration_is_chosen_and_applied(spark):
    val = scored(spark, wrong=True)
    best = {r.method: r for r in learn.best_calibration(val, "y", "p").collect()}
    rows = learn.calibrate(val, "y", "p", val).collect()
    for m, c in (("raw", "p"), ("isotonic", "p_isotonic"), ("sigmoid", "p_sigmoid")):
        assert math.isclose(best[m].brier, brier(rows, c), abs_tol=1e-6)
    low = min(best.values(), key=lambda r: r.brier).method
    assert [m for m, r in best.items() if r.chosen] == [low] and low != "raw"
    out = learn.apply_calibration(learn.best_calibration(val, "y", "p"), learn.calibrate(val, "y", "p", val)).collect()
    assert all(r.p_calibrated == r[f"p_{low}"] for r in out) and brier(out, "p_calibrated") < brier(out, "p")


def test_isotonic_calibration_is_the_rate_of_its_block(spark):
    val = scored(spark, wrong=False)
    rate = {r.p: r.y for r in val.groupBy("p").agg(F.avg("y").alias("y")).collect()}
    got = {r.p: r.p_isotonic for r in learn.calibrate(val, "y", "p", val).select("p", "p_isotonic").distinct().collect()}
    assert got.keys() == rate.keys() and all(math.isclose(got[p], rate[p], abs_tol=1e-9) for p in rate)


def test_importance_goes_to_the_feature_that_decides(spark):
    rng = random.Random(2)
    rows = [(rng.random(), rng.random(), i % 2) for i in range(300)]
    d = spark.createDataFrame([(float(y) + 0.1 * a, b, "left" if b < 0.5 else "right", y) for a, b, y in rows], "x double, z double, side string, y int")
    for kind in ("logistic", "forest", "boosted"):
        got = {r.feature: r.importance for r in learn.model_importance(learn.fit(d, ["side"], ["x", "z"], "y", kind), d).collect()}
        assert {"x", "z", "side=left", "side=right"} <= got.keys(), got
        assert got["x"] > 3 * max(v for k, v in got.items() if k != "x")


def test_contributions_by_hand(spark):
    d = spark.createDataFrame([(1, 1.0, 10.0, 5.0), (2, 3.0, 20.0, 5.0), (3, 5.0, None, 5.0)], "id long, a double, b double, c double")
    got = {r.id: [(x.feature, x.value, x.direction) for x in r.reasons] for r in learn.contributions(d, {"a": 2.0, "b": -1.0, "c": 9.0}, 2).collect()}
    assert got[1] == [("b", 5.0, "raises"), ("a", -4.0, "lowers")]  # means 3, 15 and 5
    assert got[2] == [("b", -5.0, "lowers"), ("c", 0.0, "lowers")] and got[3][0] == ("a", 4.0, "raises")


def test_batch_scores_are_written_with_their_reasons(spark, tmp_path):
    d = spark.createDataFrame([(i, float(i % 2) * 4 + i % 3, float(i % 5), i % 2) for i in range(120)], "id long, x double, z double, y int")
    model = learn.fit(d, [], ["x", "z"], "y", "logistic")
    learn.score_and_write(model, d, {"x": 1.0, "z": -2.0}, str(tmp_path / "out"), "id", 1)
    got = {r.id: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r.id: r.p for r in learn.score(model, d).collect()}
    assert got.keys() == want.keys() and all(got[i].p == want[i] for i in want)
    mx, mz = sum(i % 2 * 4 + i % 3 for i in range(120)) / 120, 2.0
    for i, r in got.items():
        x, z = (i % 2 * 4 + i % 3) - mx, -2 * ((i % 5) - mz)
        name, v = max((("x", x), ("z", z)), key=lambda t: abs(t[1]))
        assert abs(x) == abs(z) or r.reasons == f"{name} {'raises' if v > 0 else 'lowers'}"


def test_patterns_of_all_kinds_have_lasting_ids(spark):
    a = spark.createDataFrame([("often", "u1", 2.0), ("often", "u2", 3.0)], "kind string, subject string, value double")
    b = spark.createDataFrame([("odd", "u1", 1.0)], "kind string, subject string, value double")
    got = {(r.kind, r.subject): (r.id, r.value) for r in patterns.all_patterns(a, b).collect()}
    assert got == {(k, s): (hashlib.sha256(f"{k}|{s}".encode()).hexdigest()[:12], v) for k, s, v in [("often", "u1", 2.0), ("often", "u2", 3.0), ("odd", "u1", 1.0)]}
