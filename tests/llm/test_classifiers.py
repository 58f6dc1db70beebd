import random
import zlib

import numpy as np
import pytest

from tideline.llm import quality, toxicity
from tideline.llm.labelled import sample

GOOD = "the little house stood near a river and people came by in the morning to see it ".split()
ROWS = [(900, None, 9.0), (901, "", 9.0), (902, " \n ", 9.0), (903, "word " * 20000, 9.0), (None, "x y", 9.0), (5, "twice a row", 9.0), (5, "twice a row", 9.0)]


def corpus(kind, n=420):
    rng = random.Random(kind)
    docs, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        w = [rng.choice(GOOD) for _ in range(rng.choice([20, 60, 300]))]
        if kind == "quality" and bad:
            w = [x.upper() + "!!" for x in w]
        if kind == "toxic" and bad:
            w[rng.randrange(len(w))] = rng.choice(["stupidly", "moron"])
        docs.append((i, " ".join(w), 9.0))
        labels.append((i, int(not bad), int(bad)))
    return docs + ROWS, labels + [(7777, 1, 0), (3, 1, None), (None, 0, 1)]


@pytest.mark.parametrize("kind, mod, held, at", [("quality", 3, 1, 0.5), ("toxic", 4, 2, 0.3)])
def test_held_out_accuracy_and_edge_cases(spark, kind, mod, held, at):
    docs, labels = corpus(kind)
    op = quality if kind == "quality" else toxicity
    d = spark.createDataFrame(docs, "doc_id long, text string, score double")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = op.score(d, op.train(d, lab)).collect()
    assert len(got) == len(docs)
    want = {i: (q if kind == "quality" else t) for i, q, t in labels}
    right = [r.predicted == want[r.doc_id] for r in got if r.held_out and r.doc_id in want]
    assert len(right) > 60 and np.mean(right) > 0.97
    for r in got:
        assert r.held_out == (zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % mod == held)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= at)
    assert len({r.score for r in got if r.doc_id in (900, 901)}) == 1
    none = op.score(d, op.train(d, lab.limit(0))).collect()
    assert {r.score for r in none} == {0.5}
    assert op.score(d.limit(0), op.train(d.limit(0), lab)).count() == 0


def test_sample_is_bounded_and_leaves_the_held_out_fold(spark):
    docs, labels = corpus("toxic")
    d, lab = spark.createDataFrame(docs, "doc_id long, text string, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = sample(d, lab, "toxic", 4, 2, 50).collect()
    assert len(got) <= 50 and all(zlib.crc32(str(r.doc_id).encode()) % 4 != 2 for r in got)


def model_of(seed=1, width=5):
    rng = np.random.default_rng(seed)
    x, begin = rng.normal(size=(30, 7)), np.array([0, 1, 5, 12, 30])
    w = {k: rng.normal(size=s) for k, s in {"E": (7, width), "e": width, "V": (width, width), "U": (width, width), "a": width, "b": width, "c": ()}.items()}
    return w, x, begin, np.array([0.0, 1, 0, 1])


def test_forward_against_plain_loops():
    w, x, begin, _ = model_of()
    for d, (lo, hi) in enumerate(zip(begin, begin[1:])):
        h = [np.tanh(row @ w["E"] + w["e"]) for row in x[lo:hi]]
        s = [float((np.tanh(v @ w["V"]) / (1 + np.exp(-(v @ w["U"])))) @ w["a"]) for v in h]
        e = np.exp(np.array(s) - max(s))
        z = sum(q * v for q, v in zip(e / e.sum(), h))
        assert np.isclose(quality._forward(w, x, begin)[0][d], 1 / (1 + np.exp(-(z @ w["b"] + w["c"]))))


def test_gradients_against_finite_differences():
    w, x, begin, y = model_of()

    def loss(w):
        p = quality._forward(w, x, begin)[0]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    got = quality.gradients(w, x, begin, y)
    for k in w:
        for at in np.ndindex(w[k].shape):
            up, down = ({**w, k: w[k].copy()} for _ in range(2))
            up[k][at] += 1e-6
            down[k][at] -= 1e-6
            assert np.isclose((loss(up) - loss(down)) / 2e-6, got[k][at], atol=1e-7), (k, at)


def test_fit_separates():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(30, quality.WIDTH))
    begin = np.array([0, 1, 5, 12, 30])
    y = np.array([0.0, 1, 0, 1])
    m = quality.fit(x, begin, y, epochs=200, batch=4)
    assert (m.score(x, begin) > 0.5).tolist() == [False, True, False, True]


def test_ftrl_against_plain_loops():
    rng = random.Random(4)
    docs = [sorted(rng.sample(range(40), rng.randrange(12))) for _ in range(60)]
    y = np.array([float(3 in d or rng.random() < 0.1) for d in docs])
    alpha, beta, l1, l2, epochs = 0.5, 1.0, 0.3, 1.0, 3
    flat, begin = np.array([k for d in docs for k in d], np.int32), np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    m = toxicity.fit(flat, begin, y, alpha, beta, l1, l2, epochs)
    often = {k for k in range(40) if sum(k in d for d in docs) > 1}
    z, n = dict.fromkeys([*often, "bias"], 0.0), dict.fromkeys([*often, "bias"], 0.0)

    def weight(k):
        one, two = (0.0, 0.0) if k == "bias" else (l1, l2)
        return 0.0 if abs(z[k]) <= one else -(z[k] - np.sign(z[k]) * one) / ((beta + np.sqrt(n[k])) / alpha + two)

    order = np.random.default_rng(11)
    for _ in range(epochs):
        for d in order.permutation(len(docs)):
            keys = [k for k in docs[d] if k in often] + ["bias"]
            w = {k: weight(k) for k in keys}
            g = 1 / (1 + np.exp(-sum(w.values()))) - y[d]
            for k in keys:
                z[k] += g - (np.sqrt(n[k] + g * g) - np.sqrt(n[k])) / alpha * w[k]
                n[k] += g * g
    want = {k: weight(k) for k in often if weight(k)}
    assert dict(zip(m.slots.tolist(), m.weights)) == pytest.approx(want) and m.bias == pytest.approx(weight("bias"))


@pytest.mark.parametrize("op", [quality, toxicity])
def test_scores_depend_on_the_text_alone(spark, op):
    docs, labels = corpus("quality" if op is quality else "toxic", 120)
    docs += [(i, t, 1.0) for i, t in ((70, "a b"), (71, "x y z x y z x y z"), (70, "another text of the same id"))]
    d = spark.createDataFrame(docs, "doc_id long, text string, Score double")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    old, seen = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"), []
    try:
        for size, by in (("1", "doc_id"), ("7", "text"), ("10000", "doc_id")):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            rows = d.orderBy(by)
            seen.append({(r.doc_id, r.text): r.score for r in op.score(rows, op.train(rows, lab)).collect()})
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert seen[0] == pytest.approx(seen[1], abs=1e-9) and seen[0] == pytest.approx(seen[2], abs=1e-9)
