"""Toxicity: FTRL-proximal logistic regression (McMahan et al. 2013) over hashed word n-grams and skip-grams.

Features are the distinct words and their stems, word pairs and pairs with one word between them of a whole text, hashed
to 2**20 slots. Per-coordinate rates and L1 leave few weights, which are broadcast as two short arrays. The model is fitted on
the driver, in some passes over a bounded sample of labelled rows (``SAMPLE``); features that one sampled document
alone has are left out. Scoring streams every row once.

Edge cases: null, empty and wordless texts have no features and score as the bias does; without labels the score is
0.5; rows that repeat a doc_id are each scored; a null doc_id is scored, held out as the crc32 of empty text says; an empty table
gives no rows; ``score`` keeps other columns, but replaces those named as its own, in any case."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .labelled import beside, sample
from .shared import fold, read_table, text_of
from .words import ALNUM, Piece, gram_hash, grams, lists, mix, pieces

SAMPLE = 6000  # labelled rows that the model is fitted on, at most
SLOTS = 20  # bits
STEMS = (5, 7)  # bytes of a word's beginning that count as a word of their own


def stem(p: Piece, k: int) -> np.ndarray:
    """Hash of the first k bytes of each word."""
    out = np.full(len(p.start), np.uint64(k), np.uint64)
    for j in range(k):
        at = p.start + j
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + np.where(at < p.stop, p.data[np.minimum(at, len(p.data) - 1)], 0).astype(np.uint64))
    return out


def features(p: Piece) -> tuple[np.ndarray, np.ndarray]:
    """(row, slot) of the distinct features of a piece's texts, sorted."""
    h, doc, n = p.hashes, p.doc(), len(p.hashes)
    pair, ok2 = grams(p, 2)
    skip, ok3 = np.zeros(n, np.uint64), grams(p, 3)[1]
    if n > 2:
        skip[: n - 2] = mix(gram_hash([h[:-2], h[2:]]) ^ np.uint64(0x5851F42D4C957F2D))
    stems = [stem(p, k) for k in STEMS]
    slot = np.concatenate([mix(h), pair[ok2], skip[ok3], *stems]) >> np.uint64(64 - SLOTS)
    both = np.unique(np.concatenate([doc, doc[ok2], doc[ok3], *[doc] * len(stems)]).astype(np.int64) << SLOTS | slot.astype(np.int64))
    return both >> SLOTS, (both & ((1 << SLOTS) - 1)).astype(np.int32)


@dataclass
class Model:
    slots: np.ndarray  # int32, sorted
    weights: np.ndarray
    bias: float

    def score(self, row: np.ndarray, slot: np.ndarray, rows: int) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.slots, slot), max(len(self.slots) - 1, 0))
        w = np.where(self.slots[at] == slot, self.weights[at], 0.0) if len(self.slots) else np.zeros(len(slot))
        return 1 / (1 + np.exp(-(self.bias + np.bincount(row, w, rows))))


def fit(flat: np.ndarray, begin: np.ndarray, y: np.ndarray, alpha: float = 0.5, beta: float = 1.0, l1: float = 8.0, l2: float = 1.0, epochs: int = 3) -> Model:
    """FTRL-proximal, one document at a time, of the slots flat[begin[i]:begin[i + 1]]; the bias has no penalty."""
    if not len(y):
        return Model(np.zeros(0, np.int32), np.zeros(0), 0.0)
    often = np.bincount(flat, minlength=1 << SLOTS) > 1
    known = np.flatnonzero(often)
    place = (np.cumsum(often) - 1).astype(np.int32)
    size = np.add.reduceat(np.append(often[flat], False).astype(np.int64), begin[:-1]) * (np.diff(begin) > 0)
    flat, begin = place[flat[often[flat]]], np.concatenate([[0], np.cumsum(size)])
    z, n = np.zeros(len(known) + 1), np.zeros(len(known) + 1)
    pen = np.append(np.full(len(known), l1), 0.0)

    def weights(i):
        w = -(z[i] - np.sign(z[i]) * pen[i]) / ((beta + np.sqrt(n[i])) / alpha + l2 * (pen[i] > 0))
        return np.where(np.abs(z[i]) > pen[i], w, 0.0)

    rng = np.random.default_rng(11)
    for _ in range(epochs):
        for d in rng.permutation(len(y)):
            i = np.append(flat[begin[d] : begin[d + 1]], np.int32(len(known)))
            w = weights(i)
            g = 1 / (1 + np.exp(-w.sum().clip(-35, 35))) - y[d]
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha * w
            n[i] += g * g
    w = weights(np.arange(len(known) + 1))
    used = np.flatnonzero(w[:-1])
    return Model(known[used].astype(np.int32), w[used], float(w[-1]))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for p in pieces(batch.column(2), ALNUM):
            row, slot = features(p)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(p.row, p.rows), batch.column(1).slice(p.row, p.rows), lists(slot, np.searchsorted(row, np.arange(p.rows + 1)))], names=["doc_id", "y", "x"])


def train(docs: DataFrame, labels: DataFrame, mod: int = 4, held: int = 2, most: int = SAMPLE) -> Model:
    kind = dict(docs.dtypes)["doc_id"]
    rows = sample(docs, labels, "toxic", mod, held, most).mapInArrow(_features, f"doc_id {kind}, y double, x array<int>")
    got = rows.toArrow().sort_by("doc_id").combine_chunks()
    x = got["x"].combine_chunks()
    begin = np.concatenate([[0], np.cumsum(x.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    return fit(x.flatten().to_numpy(), begin, got["y"].to_numpy())


def score(docs: DataFrame, model: Model, mod: int = 4, held: int = 2, threshold: float = 0.3) -> DataFrame:
    """``docs`` with held_out, score and predicted, of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 2**20 weights
    names = beside(docs, ("score", "held_out", "predicted", "_text"))

    def run(batches):
        for batch in batches:
            for p in pieces(batch.column(len(names)), ALNUM):
                s = shared.value.score(*features(p), p.rows)
                yield pa.RecordBatch.from_arrays([c.slice(p.row, p.rows) for c in batch.columns[:-1]] + [pa.array(s)], names=[*names, "score"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in docs.select(*names).dtypes)
    out = docs.select(*names, text_of().alias("_text")).mapInArrow(run, f"{kinds}, score double")
    return out.withColumns({"held_out": fold("doc_id", mod) == held, "predicted": (F.col("score") >= threshold).cast("int")})


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, train(docs, read_table(spark, sf_dir, "labels"))).select("doc_id", "held_out", "score", "predicted")
