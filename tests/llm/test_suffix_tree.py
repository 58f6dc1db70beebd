import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tideline.llm import suffix_tree as S


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def held(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2


def base(rows):
    c = Counter(w for i, t in rows if not held(i) for w in [*words(t), None])
    n, v = sum(c.values()), len(c)
    return sorted((str(i), held(i), len(words(t)) + 1, sum(c[w] > 0 for w in [*words(t), None]), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in [*words(t), None]), 6)) for i, t in rows)


def make(n=300):
    rng = random.Random(3)
    syl = ["ba", "De", "ér", "on", "tion", "the"]
    rows = [(i, " ".join("".join(rng.choice(syl) for _ in range(rng.choice([1, 2, 3, 4]))) for _ in range(rng.choice([1, 10, 80])))) for i in range(n)]
    return rows + [(1000, None), (1001, ""), (1002, " \n"), (None, "ba ba"), (4, rows[4][1]), (4, "other"), (1003, "zz" * 3000 + " q" * 9000)]


def test_base_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 5000)
    rows = make()
    got = S.score(spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, score int")).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == base(rows)
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_empty(spark):
    assert S.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_order_of_words_matters(spark):
    rows = [(i, "a b c d " * 20) for i in range(60)] + [(1000, "a b c d " * 5), (1001, "d c b a " * 5)]
    got = {r.doc_id: r.score for r in S.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1000] > got[1001] + 3


def test_words_are_contexts_at_any_size_of_the_corpus(spark):
    rng = random.Random(8)
    text = lambda n, ws: " ".join(rng.choice(ws) for _ in range(n))
    common = [f"w{i}" for i in range(400)]
    rows = [(i, text(300, common) + " alpha w7 omega " + text(300, common)) for i in range(60)]
    rows += [(1000, "w7 omega"), (1001, "w9 omega"), (1002, "alpha w7 omega"), (1003, "alpha w9 omega")]
    got = {r.doc_id: r.score for r in S.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1000] > got[1001] + 1.2 and got[1002] > got[1003] + 3


def test_lookup():
    keys = np.random.default_rng(1).integers(0, 2**63, 3000).astype(np.uint64)
    keys = np.unique(np.concatenate([keys, np.arange(50, dtype=np.uint64)]))
    found = S.Lookup(keys[::2])
    assert found.get(keys).tolist() == [i // 2 if i % 2 == 0 else len(keys[::2]) for i in range(len(keys))]
    assert S.Lookup(keys[:0]).get(keys[:3]).tolist() == [0, 0, 0]


def brute_model(rows):
    """Training counts, states with their followers, and a function of a context and a word: its probability."""
    train = [[*words(t), "</s>"] for i, t in rows if not held(i)]
    c = Counter(tuple(w[i : i + n]) for w in train for n in range(1, 5) for i in range(len(w) - n + 1))
    total, states = sum(map(len, train)), {}
    for n in range(1, 4):
        for ctx in [g for g in c if len(g) == n and g[-1] != "</s>"]:
            pn, size = (c[ctx[1:]] if n > 1 else total), c[ctx]
            f = {g[-1]: k for g, k in c.items() if len(g) == n + 1 and g[:-1] == ctx and k >= S.SEEN}
            pc = {w: c[(*ctx[1:], w)] for w in f}
            gain = {w: k * math.log(k * pn / (size * pc[w])) for w, k in f.items()}
            f = {w: k for w, k in f.items() if 2 * gain[w] > math.log(total)}
            rest, prest = size - sum(f.values()), pn - sum(pc[w] for w in f)
            g2 = 2 * (sum(gain[w] for w in f) + (rest * math.log(rest * pn / (size * prest)) if rest and prest else 0))
            if f and g2 > len(f) * math.log(total):
                states[ctx] = f, size, (rest + S.ALPHA) / (size + S.ALPHA)
    once = max(1, sum(k == 1 for g, k in c.items() if len(g) == 1 and g[0] != "</s>"))

    def p(ctx, word):
        if not ctx:
            return (c[(word,)] or once) / (total + once)
        if ctx not in states:
            return p(ctx[1:], word)
        f, n, left = states[ctx]
        return f.get(word, 0) / (n + S.ALPHA) + left * p(ctx[1:], word)

    return c, states, p


@pytest.mark.parametrize("size", ["1", "10000"])
def test_scores_against_brute_force(spark, monkeypatch, size):
    rng = random.Random(9)
    part = ["a b c d", "x b c e", "x y", "q", "r s", *(f"n{i}" for i in range(30))]
    rows = [(i, " ".join(rng.choice(part) for _ in range(40))) for i in range(150)] + [(500, "a b c d unknown x b c e"), (501, None), (502, "unknown")]
    c, states, p = brute_model(rows)
    assert {len(s) for s in states} == {1, 3}
    monkeypatch.setattr(S, "BLOCK", 3000)
    monkeypatch.setattr(S, "HELD", 50)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        got = {r.doc_id: r.score for r in S.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    for i, t in rows:
        w = [*words(t), "</s>"]
        assert abs(got[i] - sum(math.log10(p(tuple(w[max(0, k - 3) : k]), x)) for k, x in enumerate(w))) < 1e-8
    vocabulary = [g[0] for g in c if len(g) == 1] + ["never seen"]
    for ctx in [(), *list(states)[:20], ("n1", "a", "b")]:
        assert abs(sum(p(ctx, w) for w in vocabulary) - 1) < 1e-9


@pytest.mark.parametrize("n", [1, 2, 1000])
def test_keys_and_counts_are_packed(n):
    rng = np.random.default_rng(n)
    keys = np.unique(np.concatenate([rng.integers(-(2**63), 2**63 - 1, n), [-(2**63), 2**63 - 1][: n - 1]]).astype(np.int64))
    assert S.unpacked_keys(S.packed_keys(keys)).tolist() == keys.tolist()
    for top in (1, 256, 2**40, 2**53):
        c = rng.integers(0, top, n)
        assert S.unpacked(S.packed(c)).tolist() == c.tolist()
    bucket = S._bucket(keys, 7)
    assert (np.diff(bucket) >= 0).all() and 0 <= bucket.min() and bucket.max() < 7
    many = np.unique(rng.integers(-(2**63), 2**63 - 1, 30000))
    assert len(S.packed_keys(many)) < 7.1 * len(many)


def test_parts_of_a_gram_come_from_few_texts(spark):
    rng = random.Random(5)
    words_ = [f"w{i}" for i in range(60)]
    texts = spark.createDataFrame([(" ".join(rng.choice(words_) for _ in range(200)),) for _ in range(400)], "text string").repartition(8)
    got = S.grams(texts, S._counts(texts, lambda p: [p.hashes]))
    shared = S.screen(got.select(S._at(S.F.col("key"), S.F.col("src")).alias("key")))
    rows = texts.mapInArrow(lambda b: S._parts(b, shared), "key long, ctx long, low long, up long, d long")
    keys = {r.key for r in got.select("key").collect()}
    found = [r.key for r in rows.select("key").collect()]
    assert len(keys) > 3000 and set(found) >= keys
    assert len(found) < 2 * len(keys)  # each of the 8 tasks has nearly all of them
