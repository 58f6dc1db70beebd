"""Exact duplicates: binary-fuse filters of immutable snapshots screen a batch; positives are checked byte by byte.

A snapshot's distinct digests are dealt to buckets of bounded size and a static filter is built for each (Graf and
Lemire 2022), once: with ``store`` they are kept beside the snapshot and later batches read them. Of an incoming batch,
equal digests are grouped first; the groups meet their bucket's filters, and only those that a filter lets through join
the snapshots' exact digests. The texts of each digest are then compared whole: the smallest and the largest of them,
found with partial results in every task, are equal if all are, so no task gets all copies of a text.

Edge cases: null text counts as empty; a null doc_id sorts after all others and ``kept`` compares null-safe; rows that
repeat a doc_id are all kept if that id is the smallest; an empty table gives no rows; other columns are ignored."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bitmap import bitmap, screened
from .shared import exists, fold, read_table, text_of, written
from .words import mix

U64 = np.uint64
BUCKET = 1 << 16  # distinct digests that one filter holds, about


class FuseFilter:
    """A static 3-wise binary-fuse filter with 8-bit fingerprints: no false negatives, about 0.4 % false positives."""

    def __init__(self, seed: int, segment: int, segments: int, prints: np.ndarray):
        self.seed, self.segment, self.segments, self.prints = seed, segment, segments, prints

    @classmethod
    def build(cls, keys: np.ndarray) -> FuseFilter:
        keys = np.unique(np.asarray(keys).view(U64))
        n = len(keys)
        segment = min(1 << 18, 1 << max(2, int(math.log(max(n, 2)) / math.log(3.33) + 2.25)))
        room = int(max(n, 4) * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 4)))) + 8
        segments = max(1, -(-room // segment) - 2)
        for seed in range(1, 200):
            f = cls(seed, segment, segments, np.zeros((segments + 2) * segment, np.uint8))
            if f._fill(keys):
                return f
            if seed % 20 == 0:
                segments += max(1, segments // 10)
        raise RuntimeError("no binary-fuse filter found")

    def _slots(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = mix(keys + mix(np.array([self.seed], U64)))
        first = ((h >> U64(32)) * U64(self.segments) >> U64(32)).astype(np.int64)
        low, mask = h & U64(0xFFFFFFFF), U64(self.segment - 1)
        at = [((low * U64(m) >> U64(13)) & mask).astype(np.int64) for m in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)]
        return np.stack([(first + i) * self.segment + a for i, a in enumerate(at)]), (mix(h) & U64(0xFF)).astype(np.uint8)

    def _fill(self, keys: np.ndarray) -> bool:
        slots, prints = self._slots(keys)
        count = np.bincount(slots.ravel(), minlength=len(self.prints))
        which = np.zeros(len(self.prints), np.int64)
        for s in slots:
            np.bitwise_xor.at(which, s, np.arange(len(keys)))
        rounds, left, front = [], len(keys), np.flatnonzero(count == 1)
        while len(front):
            key, first = np.unique(which[front], return_index=True)
            rounds.append((key, front[first]))
            left -= len(key)
            for s in slots[:, key]:
                np.subtract.at(count, s, 1)
                np.bitwise_xor.at(which, s, key)
            touched = np.unique(slots[:, key])
            front = touched[count[touched] == 1]
        if left:
            return False
        for key, slot in reversed(rounds):
            a, b, c = (self.prints[s] for s in slots[:, key])
            self.prints[slot] = prints[key] ^ a ^ b ^ c  # its own slot still holds 0
        return True

    def has(self, keys: np.ndarray) -> np.ndarray:
        (a, b, c), prints = self._slots(np.asarray(keys).view(U64))
        return (self.prints[a] ^ self.prints[b] ^ self.prints[c]) == prints


def filters(keys: DataFrame, store: str | None = None) -> DataFrame:
    """The filters of a snapshot's distinct keys (key long): bucket, buckets, and a filter's numbers and bytes.

    With ``store``, a folder, they are written there, or read if they are there already."""
    spark = keys.sparkSession
    if store and exists(spark, f"{store}/_SUCCESS"):
        return spark.read.parquet(store)
    buckets = max(1, -(-keys.count() // BUCKET))

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        f = FuseFilter.build(rows["key"].to_numpy(np.int64))
        return pd.DataFrame({"bucket": rows["bucket"].iloc[:1], "buckets": buckets, "seed": f.seed, "segment": f.segment, "segments": f.segments, "prints": [f.prints.tobytes()]})

    rows = keys.select(F.pmod("key", F.lit(buckets)).cast("int").alias("bucket"), "key").distinct()
    built = rows.groupBy("bucket").applyInPandas(build, "bucket int, buckets int, seed int, segment int, segments int, prints binary")
    if store is None:
        return written(built, "filters")
    built.write.parquet(store)
    return spark.read.parquet(store)


def screen(keys: DataFrame, built: DataFrame) -> DataFrame:
    """The distinct keys (key long) that a snapshot's filters let through.

    A bucket's share of a batch that is larger than the snapshot is dealt to as many groups, each with a copy of the
    filter, as leave about ``BUCKET`` keys to one; so no task holds more, and the copies grow with the batch only."""

    def look(of: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        key = rows["key"].to_numpy(np.int64)
        found = np.zeros(len(key), bool)
        for f in of.itertuples():
            found |= FuseFilter(f.seed, f.segment, f.segments, np.frombuffer(f.prints, np.uint8)).has(key)
        return pd.DataFrame({"key": key[found]})

    buckets = (built.agg(F.max("buckets")).first()[0]) or 1
    salts = max(1, -(-keys.count() // (buckets * BUCKET)))
    rows = keys.select("key", F.pmod("key", F.lit(buckets)).cast("int").alias("bucket"), F.pmod(F.xxhash64("key"), F.lit(salts)).cast("int").alias("salt"))
    copies = built.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return copies.groupBy("bucket", "salt").cogroup(rows.groupBy("bucket", "salt")).applyInPandas(look, "key long")


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(text_of(text), r"[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def exact_dedup(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch_col: str = "batch", digest: Callable[[Column], Column] = sha256, store: str | None = None) -> DataFrame:
    """Groups of equal normalised texts over immutable snapshots and one incoming batch.

    ``batch_col`` is an int: 0, 1, ... number the snapshots, -1 marks the incoming batch. Returns (doc_id, keep_id,
    group_size, kept, text_sha256), one row for each input row. ``digest`` may be replaced, as by tests, with a weaker
    one: texts of the same digest that differ are told apart by their bytes. ``store`` is a folder for the snapshots'
    filters, as in ``filters``."""
    d = rows.select(F.col(id_col).alias("doc_id"), F.col(batch_col).cast("int").alias("snapshot"), normalised(text_col).alias("text"))
    d = d.withColumn("digest", digest(F.col("text")))
    t = written(d.select("doc_id", "snapshot", "digest", F.xxhash64("digest").alias("key"), sha256(F.col("text")).alias("text_sha256")), "digests")
    groups = written(t.groupBy("snapshot", "digest", "key").agg(F.count("*").alias("n"), F.min("doc_id").alias("low")), "groups")
    old, new = groups.where("snapshot >= 0"), groups.where("snapshot < 0")
    maybe = new.select("key").limit(0)
    for k in sorted(r[0] for r in old.select("snapshot").distinct().collect()):  # one row a snapshot
        built = filters(old.where(F.col("snapshot") == k).select("key"), store and f"{store}/snapshot-{k}")
        maybe = maybe.unionByName(screen(new.select("key").distinct(), built))
    maybe = written(maybe.distinct(), "maybe")
    met = new.join(maybe, "key", "left_semi")
    alone = new.join(maybe, "key", "left_anti").select("digest", "n", "low")
    together = old.unionByName(met).groupBy("digest").agg(F.sum("n").alias("n"), F.min("low").alias("low"))
    more = written(together.unionByName(alone).where("n > 1"), "repeated")
    # Byte check of the digests that occur more than once.
    texts = screened(d.select("doc_id", "digest", "text"), F.xxhash64("digest"), bitmap(more.select("digest"), "digest"))
    unlike = written(texts.groupBy("digest").agg(F.min("text").alias("a"), F.max("text").alias("z")).where("a <> z").select("digest"), "unlike")
    known = F.col("n").isNotNull()
    columns = ["doc_id", F.coalesce("n", F.lit(1)).alias("group_size"), F.when(known, F.col("low")).otherwise(F.col("doc_id")).alias("keep_id"), "text_sha256"]
    if unlike.isEmpty():
        found = t.join(more.hint("merge"), "digest", "left").select(*columns)
    else:  # different texts of one digest: group by the texts themselves
        found = t.join(unlike, "digest", "left_anti").join(more.hint("merge"), "digest", "left").select(*columns)
        rows_ = texts.join(unlike, "digest", "left_semi").withColumn("text_sha256", sha256(F.col("text")))
        apart = rows_.groupBy("digest", "text").agg(F.count("*").alias("n"), F.min("doc_id").alias("low"))
        found = found.unionByName(rows_.join(apart, ["digest", "text"]).select(*columns))
    return found.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def in_batches(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Deal the rows to two snapshots and an incoming batch, by crc32 of the id."""
    return docs.withColumn("batch", F.element_at(F.array(F.lit(0), F.lit(1), F.lit(-1)), (fold(id_col, 3) + 1).cast("int")))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup(in_batches(docs))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""
