"""Splits and ranking quality with repeated keys, null scores and null groups."""

import datetime as dt
import random
from collections import Counter

from tideline.operators import learn

T0 = dt.datetime(2024, 1, 1)


def test_temporal_split_keeps_every_row_once(spark):
    r = random.Random(1)
    for seed in range(4):
        rows = [(r.choice([None, 1, 2, 3]), r.choice([None, *[T0 + dt.timedelta(seconds=r.choice([0, 5, 90_000])) for _ in range(6)]]), i) for i in range(40)]
        if seed == 1:
            rows = [(7, T0, i) for i in range(5)]
        if seed == 2:
            rows = [(7, T0, 1)] * 5 + [(8, T0, 1)]
        if seed == 3:
            rows = [(1, None, 1)] * 3
        got = learn.temporal_split(spark.createDataFrame(rows, "id long, t timestamp, x long"), "t", "id", 0.8).collect()
        assert Counter((x.id, x.t, x.x) for x in got) == Counter(rows)
        dated = sorted((x for x in rows if x[1]), key=lambda x: (x[1], x[0] is not None, x[0] or 0))
        n = int(len(dated) * 0.8)
        train = [(x.t, x.id) for x in got if x.split == "train"]
        assert Counter(train) == Counter((x[1], x[0]) for x in dated[:n])
        assert sum(x.split == "undated" for x in got) == len(rows) - len(dated)


def auc(rows):
    pos, neg = [p for y, p in rows if y == 1], [p for y, p in rows if y == 0]
    return round(sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg)), 6)


def test_ranking_quality_with_null_scores_and_groups(spark):
    rows = [(1, 0.9, "a"), (0, 0.1, "a"), (1, None, "a"), (0, None, "a"), (None, 0.5, "a"), (1, 0.3, None), (0, 0.4, None), (1, 0.8, None), (0, 0.2, None)]
    d = spark.createDataFrame(rows, "y int, p double, g string")
    got = {x.g: x for x in learn.ranking_quality(d, "y", "p", "g").collect()}
    assert {g: x.roc_auc for g, x in got.items()} == {"a": 1.0, None: auc([x[:2] for x in rows if x[2] is None])}
    all_ = learn.ranking_quality(d, "y", "p").first()
    known = [x[:2] for x in rows if x[0] is not None and x[1] is not None]
    assert all_.roc_auc == auc(known) and all_.brier == round(sum((p - y) ** 2 for y, p in known) / len(known), 6)
    assert {x.g: x["rows"] for x in learn.evaluate(d, "y", "p", "g").collect()} == {"a": 5, None: 4}
