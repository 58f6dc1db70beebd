"""Training-order materialisation: token sequences in a keyed random order, in shards of fixed-stride records.

Whole texts become token ids, an end id after each, cut into sequences of ``LENGTH`` ids. The table of sequences is
written once and is what the order is defined over, so with ``store`` a later run finds it and has the same order: its
rows are numbered without gaps, and a keyed Feistel permutation
with cycle-walking (Black and Rogaway 2002) gives every number its slot in 0 .. M - 1, so no row is sorted and any slot
can be computed again from key and number. Rows then go straight to the partition of their shard, a range of slots, and
are ordered there. ``write_shards`` writes each shard as one file of equal records: slot s is at byte (s mod shard) *
stride, so reading is sequential and may resume at any slot. A shard grows with the number of records, so that there are
65,536 shards at most.

Edge cases: null counts as empty, and an empty text is the one end id; rows that repeat a doc_id and null ids are kept;
an empty table gives no rows; other columns are ignored. Records have 16-bit ids, or 32-bit ones if ``wide``; an id that
doesn't fit is an error."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .packing import cut
from .shared import exists, read_table, text_of, written
from .tokens import default_path, encoder
from .words import mix

LENGTH, END, KEY, SHARD = 512, 50256, 20240229, 8192
TAIL = "\n\n"  # after every record in a shard
ROUNDS = 6


def permute(i: np.ndarray, m: int, key: int, back: bool = False) -> np.ndarray:
    """The slots of numbers i < m, a permutation of 0 .. m - 1 for each key; ``back`` inverts it."""
    half = max(1, (max(m - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(key))
    out, left = np.asarray(i).astype(np.uint64), np.arange(len(i))
    while len(left):
        x = out[left]
        lo, hi = x & mask, x >> shift
        for k in keys[::-1] if back else keys:
            if back:
                lo, hi = hi ^ (mix(lo ^ k) & mask), lo
            else:
                lo, hi = hi, lo ^ (mix(hi ^ k) & mask)
        out[left] = hi << shift | lo
        left = left[out[left] >= np.uint64(m)]  # outside the domain: walk on
    return out.astype(np.int64)


def shard_size(m: int) -> int:
    """Records in a shard, for m in all."""
    return SHARD * max(1, -(-m // (SHARD << 16)))


def _sequences(batches: Iterator[pa.RecordBatch], path: str, length: int, end: int, wide_ids: bool) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (doc_id, seq, n_tokens, ids_crc32, ids), ids as little-endian numbers."""
    encode, last = encoder(path).encode, np.array([end], "<u4").tobytes()
    for batch in batches:
        rows, seq, n, crc, ids = [], [], [], [], []
        for i, text in enumerate(batch.column(1)):
            for k, (_, piece) in enumerate(cut(encode(text.as_py()) + last, length)):
                wide = np.frombuffer(piece, "<u4")
                if not wide_ids and wide.max() > 65535:
                    raise ValueError("token ids over 16 bits")
                rows.append(i)
                seq.append(k)
                n.append(len(wide))
                crc.append(zlib.crc32(piece))
                ids.append(piece if wide_ids else wide.astype("<u2").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(seq, pa.int32()), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "seq", "n_tokens", "ids_crc32", "ids"])


def materialise(docs: DataFrame, path: str | None = None, length: int = LENGTH, end: int = END, key: int = KEY, shard: int | None = None, id_col: str = "doc_id", text_col: str = "text", store: str | None = None, wide: bool = False) -> DataFrame:
    """(doc_id, seq, n_tokens, ids_crc32, slot, shard, at, record): every sequence in its place, shards in partitions.

    ``record`` has ``length`` ids, the last sequence of a text filled up with the end id. ``store`` is a folder for the
    table of sequences, which is read if it is there."""
    path, spark = path or default_path(), docs.sparkSession
    d = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    kind = dict(d.dtypes)["doc_id"]
    t = d.mapInArrow(lambda b: _sequences(b, path, length, end, wide), f"doc_id {kind}, seq int, n_tokens long, ids_crc32 long, ids binary")
    t = t.withColumn("rid", F.monotonically_increasing_id())
    if store is None:
        t = written(t, "sequences")
    else:
        if not exists(spark, f"{store}/_SUCCESS"):
            t.write.parquet(store)
        t = spark.read.schema(t.schema).parquet(store)
    sizes = t.groupBy(F.shiftright("rid", 33).alias("part")).agg(F.count("*").alias("n")).collect()  # a row for each partition
    parts = np.array(sorted((r["part"], r["n"]) for r in sizes), np.int64).reshape(-1, 2)
    first = np.cumsum(parts[:, 1]) - parts[:, 1]
    m = int(parts[:, 1].sum())
    shard = shard or shard_size(m)
    filler = np.array([end], "<u4" if wide else "<u2").tobytes()

    def place(batches):
        for batch in batches:
            rid = batch.column(5).to_numpy()
            slot = permute(first[np.searchsorted(parts[:, 0], rid >> 33)] + (rid & ((1 << 33) - 1)), m, key)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(slot), pa.array((slot // shard).astype(np.int32)), pa.array((slot % shard).astype(np.int32)), batch.column(4)], names=["doc_id", "seq", "n_tokens", "ids_crc32", "slot", "shard", "at", "ids"])

    out = t.select("doc_id", "seq", "n_tokens", "ids_crc32", "ids", "rid").mapInArrow(place, f"doc_id {kind}, seq int, n_tokens long, ids_crc32 long, slot long, shard int, at int, ids binary")
    out = out.repartitionById(max(1, -(-m // shard)), F.col("shard")).sortWithinPartitions("slot")
    full = F.rpad(F.col("ids"), length * len(filler), F.lit(filler))
    return out.select("doc_id", "seq", "n_tokens", "ids_crc32", "slot", "shard", "at", full.alias("record"))


def write_shards(records: DataFrame, path: str) -> None:
    """One file a shard under ``path``/shard=N, records and ``TAIL`` in turn; Spark commits each file as a whole."""
    records.select("shard", F.col("record").cast("string").alias("value")).write.partitionBy("shard").option("lineSep", TAIL).text(path)


def read_shards(path: str, slot: int = 0, length: int = LENGTH, shard: int = SHARD) -> Iterator[np.ndarray]:
    """The ids of each record from a slot on, in training order, from a local or mounted folder."""
    stride = length * 2 + len(TAIL)
    number = slot // shard
    while os.path.isdir(at := f"{path}/shard={number}"):
        (name,) = (n for n in os.listdir(at) if re.match(r"part-", n))
        with open(f"{at}/{name}", "rb") as f:
            f.seek((slot - number * shard) * stride)
            while len(record := f.read(stride)) == stride:
                yield np.frombuffer(record[: length * 2], "<u2")
        number += 1
        slot = number * shard


def op8_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(read_table(spark, sf_dir, "documents"))
