"""A fixed-size bitmap of 64-bit keys, to screen rows before a shuffle. It has false positives and no false negatives."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BITS = 27  # 16 MB: what is broadcast has this bound at any size of the input
BLOCK = 10  # words of a block that the executors pack, a power of two


def bitmap(keys: DataFrame, key: str, max_bits: int = MAX_BITS):
    """Broadcast a bitmap of the long column ``key``; built in the executors, 64 bits a row, at most 2**max_bits bits.

    Beyond that many keys it lets more rows through; the exact join that follows it drops them."""
    n = keys.count()
    bits = min(max_bits, max(13, math.ceil(math.log2(16 * n + 1))))
    slot = F.shiftrightunsigned(F.xxhash64(key), 64 - bits)
    rows = keys.where(F.col(key).isNotNull()).groupBy(F.shiftright(slot, 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot, F.lit(64)).cast("int"))).alias("v"))
    blocks = rows.groupBy(F.shiftright("w", BLOCK).alias("at")).applyInArrow(_block, "at long, bits binary").toArrow()
    words = np.zeros(1 << (bits - 6), np.uint64)
    for at, block in zip(blocks["at"].to_pylist(), blocks["bits"]):
        some = np.frombuffer(block.as_buffer(), np.uint64)
        words[at << BLOCK : (at << BLOCK) + len(some)] = some[: len(words)]
    return keys.sparkSession.sparkContext.broadcast((bits, words))


def _block(rows: pa.Table) -> pa.Table:
    """Words of one block, (w, v), to its place and bytes; the driver gets 16 MB of these at most."""
    w, v = rows["w"].to_numpy(), rows["v"].to_numpy()
    block = np.zeros(1 << BLOCK, np.int64)
    block[w & ((1 << BLOCK) - 1)] = v
    return pa.table({"at": w[:1] >> BLOCK, "bits": pa.array([block.tobytes()], pa.binary())})


def done(*shared) -> None:
    """Drop bitmaps whose users' results have been written."""
    for b in shared:
        b.destroy()


def hit(shared: tuple[int, np.ndarray], hashed: np.ndarray) -> np.ndarray:
    """Which of ``hashed`` (xxhash64 of the keys, as Spark computes it) have their bit set."""
    bits, words = shared
    slot = np.asarray(hashed).view(np.uint64) >> np.uint64(64 - bits)
    return (words[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)


_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def xxhash64_of(keys: np.ndarray) -> np.ndarray:
    """XXH64 of 8-byte keys with seed 42, the public algorithm that ``F.xxhash64`` applies to a long column."""

    def rot(x, r):
        return (x << np.uint64(r)) | (x >> np.uint64(64 - r))

    k = np.asarray(keys).view(np.uint64)
    h = np.uint64(42) + _P5 + np.uint64(8)
    h = h ^ (rot(k * _P2, 31) * _P1)
    h = rot(h, 27) * _P1 + _P4
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def screened(df: DataFrame, hashed: Column, shared, there: bool = True) -> DataFrame:
    """The rows of ``df`` whose ``hashed`` (F.xxhash64 of their key) may be in the bitmap, or else those that are not."""
    whole = df.withColumn("_slot", hashed)

    def keep(batches):
        for batch in batches:
            at = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(hit(shared.value, at) == there))

    return whole.mapInArrow(keep, whole.schema).drop("_slot")
