import numpy as np
from pyspark.sql import functions as F
from tideline.llm import bitmap as B


def test_full_size(spark):
    keys = spark.range(4_300_000).select((F.col("id") * 7919).alias("key"))
    shared = B.bitmap(keys, "key")
    bits, words = shared.value
    assert bits == 27 and len(words) == 1 << 21
    ids = np.arange(4_300_000, dtype=np.int64) * 7919
    assert B.hit(shared.value, B.xxhash64_of(ids)).all()
    share = np.bitwise_count(words).sum() / (1 << 27)
    assert abs(share - (1 - np.exp(-4.3e6 / (1 << 27)))) < 0.001
    B.done(shared)


def test_small_and_empty(spark):
    keys = spark.createDataFrame([(1,), (None,), (5,)], "key long")
    shared = B.bitmap(keys, "key").value
    assert B.hit(shared, B.xxhash64_of(np.array([1, 5]))).all() and not B.hit(shared, B.xxhash64_of(np.arange(10, 60))).any()
    assert not B.bitmap(keys.where("key > 9"), "key").value[1].any()
