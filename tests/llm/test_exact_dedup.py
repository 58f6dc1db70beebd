import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from tideline.llm import exact_dedup as E


def brute(rows):
    norm = [(i, re.sub(r"[\x20\x09-\x0d]+", " ", t or "")) for i, t in rows]
    out = []
    for i, t in norm:
        same = [j for j, u in norm if u == t]
        out.append((i, min(same), len(same), i == min(same), hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out)


ROWS = [(5, "a  b"), (3, "a\tb"), (9, "a b"), (1, "c"), (2, None), (4, ""), (8, " "), (7, "long " * 30000), (6, "long " * 30000), (10, "A b"), (11, "a b")]


def test_fuse_filter():
    for n in (0, 1, 2, 3, 10, 1000, 40000):
        keys = np.random.default_rng(n).integers(-(2**63), 2**63 - 1, n)
        f = E.FuseFilter.build(keys)
        assert f.has(keys).all()
        assert f.has(np.arange(20000)).mean() < 0.02


def test_against_brute_force(docs):
    got = E.exact_dedup(E.in_batches(docs(ROWS)))
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect())) == brute(ROWS)


def test_weak_digest_is_settled_by_bytes(docs):
    got = E.exact_dedup(E.in_batches(docs(ROWS)), digest=lambda t: F.substring(F.sha2(t.cast("binary"), 256), 1, 0))
    assert sorted(map(tuple, got.collect())) == brute(ROWS)


def test_empty_and_null_id(docs):
    assert E.exact_dedup(E.in_batches(docs([]))).count() == 0
    got = {r.doc_id: r for r in E.exact_dedup(E.in_batches(docs([(None, "x"), (4, "x"), (None, "y")]))).where("text_sha256 is not null").collect()}
    assert got[4].kept and got[4].group_size == 2


def test_filters_of_a_snapshot_are_kept(spark, docs, tmp_path):
    rows = E.in_batches(docs(ROWS))
    first = sorted(map(tuple, E.exact_dedup(rows, store=f"{tmp_path}/f").collect()))
    kept = spark.read.parquet(f"{tmp_path}/f/snapshot-0")
    before = sorted(bytes(r.prints) for r in kept.collect())
    assert sorted(map(tuple, E.exact_dedup(rows, store=f"{tmp_path}/f").collect())) == first == brute(ROWS)
    assert sorted(bytes(r.prints) for r in kept.collect()) == before


def test_batch_larger_than_the_snapshot_is_dealt_to_more_groups(spark, docs, monkeypatch):
    monkeypatch.setattr(E, "BUCKET", 4)
    keys = spark.range(200).select(F.xxhash64("id").alias("key"))
    few = keys.limit(3)
    got = E.screen(keys, E.filters(few))
    found = [r.key for r in got.collect()]
    assert len(found) == len(set(found)) and {r.key for r in few.collect()} <= set(found) and len(found) < 20
    assert sorted(map(tuple, E.exact_dedup(E.in_batches(docs(ROWS))).collect())) == brute(ROWS)
