import hashlib
import random
import zlib
from bisect import bisect_left, bisect_right
from collections import defaultdict

import pytest
from tideline.llm import sharding


def plain_cuts(sizes, shards):
    """The same rule over a list: smallest capacity by trying sums, greedy check, even cuts under it."""
    sums = [0]
    for s in sizes:
        sums.append(sums[-1] + s)
    total = sums[-1]
    upto = lambda x: sums[bisect_right(sums, x) - 1]
    beyond = lambda x: sums[bisect_left(sums, min(x, total))]

    def fits(c):
        at = 0
        for _ in range(shards):
            at = upto(at + c)
        return at == total

    spans = sorted({b - a for a in sums for b in sums if b > a})
    best = next(c for c in spans if c * shards >= total and fits(c))
    need = [total]
    for _ in range(shards - 1):
        need.append(beyond(max(0, need[-1] - best)))
    need.reverse()
    cuts = [0]
    for j in range(shards):
        share = cuts[-1] + -(-(total - cuts[-1]) // (shards - j))
        cuts.append(max(need[j], upto(share), beyond(min(cuts[-1] + 1, total))))
    return best, cuts[1:]


def check(rows, got, shards):
    groups, first = defaultdict(list), {}
    for i, t in rows:
        groups[t or ""].append(i)
    for t, ids in groups.items():
        first[t] = min((i is not None, i) for i in ids if i is not None or all(x is None for x in ids))
    ordered = sorted(groups, key=lambda t: (first[t], hashlib.sha256(t.encode()).digest()))
    sizes = [len(groups[t]) * (len(t.encode()) + 8) for t in ordered]
    best, cuts = plain_cuts(sizes, shards)
    shard_of, s = {}, 0
    for t, n in zip(ordered, sizes):
        s += n
        shard_of[t] = sum(c < s for c in cuts)
    assert len(got) == len(rows)
    text = defaultdict(list)
    for i, t in rows:
        text[i].append(t or "")
    slots, size = defaultdict(list), defaultdict(int)
    for r in got:
        t = next(t for t in text[r["doc_id"]] if zlib.crc32(t.encode()) == r["text_crc32"])
        assert (r["size"], r["shard"]) == (len(t.encode()) + 8, shard_of[t])
        slots[r["shard"]].append(r["slot"])
        size[r["shard"]] += r["size"]
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(size.values()) == best
    return size


@pytest.mark.parametrize("seed,shards,fan", [(0, 5, 16), (1, 24, 64), (2, 7, 1 << 15), (3, 3, 8)])
def test_brute_force(spark, docs, seed, shards, fan):
    r = random.Random(seed)
    texts = ["".join(r.choices("abé ", k=int(r.paretovariate(1) * 5) % 400)) for _ in range(120)]
    rows = [(i, r.choice(texts[:3]) if r.random() < 0.2 else texts[i % 120]) for i in r.sample(range(1000), 200)]
    check(rows, sharding.shard(docs(rows), shards, fan).collect(), shards)


def test_hot_group_is_one_shard_and_the_rest_is_even(spark, docs):
    rows = [(i, "the same " * 9 if i % 3 == 0 else f"text {i:05d} " * (1 + i % 4)) for i in range(900)]
    size = check(rows, sharding.shard(docs(rows), 8, 64).collect(), 8)
    rest = sorted(size.values())[:-1]
    assert len(size) == 8 and rest[-1] < 1.2 * rest[0]


def test_edges(spark, docs):
    assert sharding.shard(docs([])).collect() == []
    rows = [(None, None), (None, "b"), (1, ""), (1, ""), (2, "é" * 5000), (2, "b"), (3, None)]
    check(rows, sharding.shard(docs(rows), 4).collect(), 4)
    one = sharding.shard(docs([(7, None)])).collect()
    assert [(r["shard"], r["slot"], r["size"], r["text_crc32"]) for r in one] == [(0, 0, 8, 0)]


def test_extra_columns_with_clashing_names(spark):
    names = "doc_id long, text string, size string, key string, salt string, shard string, upto string, first string, n string"
    rows = [(i, "x" * i, *"abcdefg") for i in range(5)]
    check([r[:2] for r in rows], sharding.shard(spark.createDataFrame(rows, names), 2).collect(), 2)


def test_query(spark):
    from pyspark.sql import functions as F

    sf = "/root/testdata/sf0.001"
    got = sharding.op13_minimax_shards(spark, sf)
    assert got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(rows, got.where(F.col("law") == "bytes").collect(), 24)
