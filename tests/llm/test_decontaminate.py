import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tideline.llm import decontaminate as D
from tideline.llm.bitmap import xxhash64_of
from tideline.llm.words import ALNUM, SPACED, pieces


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items):
    out = []
    windows = []
    for i, t in items:
        w = words(t)
        m = min(10, len(w))
        windows += [(i, w[s : s + m]) for s in range(len(w) - m + 1) if m]
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for i, g in windows:
            for s in range(len(w) - len(g) + 1):
                if w[s : s + len(g)] == g:
                    hit |= {*range(s, s + len(g))}
                    ids.add(str(i))
        out.append((d, len(w), len(hit), len(ids), sorted(ids), bool(hit)))
    return sorted(out, key=str)


def run(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("x")).withColumn("key", F.lit(1))
    got = D.decontaminate(d, spark.createDataFrame(items, "item_id long, text string").withColumn("n_words", F.lit(3)))
    return sorted([(r.doc_id, r.n_words, r.n_hit, r.n_items, r.item_ids, r.contaminated) for r in got.collect()], key=str)


def test_word_hashes(spark):
    texts = ["Ab céÉ x", None, "", "  ", "a b", "x" * 70000, "céÉ ab  x", "1-2_3"]
    for inside, pat in ((ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), (SPACED, r"[^\x20\x09-\x0D]+")):
        for size in (1, 1 << 20):
            seen = {}
            for p in pieces(pa.array(texts), inside, size):
                for r in range(p.rows):
                    want = re.findall(pat, re.sub("[A-Z]", lambda m: m[0].lower(), texts[p.row + r] or ""))
                    got = p.hashes[p.begin[r] : p.begin[r + 1]].tolist()
                    assert len(got) == len(want)
                    for w, h in zip(want, got):
                        assert seen.setdefault(w, h) == h
            assert len(set(seen.values())) == len(seen)
    keys = np.array([0, -1, 5, 2**62], np.int64)
    assert xxhash64_of(keys).view(np.int64).tolist() == [r[0] for r in spark.createDataFrame([(int(k),) for k in keys], "k long").select(F.xxhash64("k")).collect()]


def test_against_brute_force(spark):
    rng = random.Random(4)
    vocab = ["a", "b", "c", "D", "é"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.choice([4, 6, 9, 10, 11, 30]))) for i in range(12)] + [(3, text(12)), (40, None), (41, "..."), (42, "lone")]
    docs = [(i, text(rng.choice([0, 3, 9, 10, 40, 200]))) for i in range(40)] + [(100, None), (101, ""), (7, text(30)), (102, items[5][1]), (102, items[5][1]), (103, "x, " + items[4][1].upper() + "! LONE"), (None, items[6][1]), (104, text(6000))]
    assert run(spark, docs, items) == brute(docs, items)
    assert run(spark, [], items) == []
    assert run(spark, docs[:3], []) == brute(docs[:3], [])
