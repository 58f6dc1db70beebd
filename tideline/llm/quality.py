"""Quality classifier: gated-attention multiple-instance learning (Ilse et al. 2018) over a document's passages.

Every passage of a whole text is encoded from its letters, punctuation, word lengths and repetitions and from a hashed
bag of its words; a gated attention learned from document labels weighs the passages, and the weighted representation
is scored. The model, a few thousand numbers, is fitted on the driver from a bounded sample of labelled rows
(``SAMPLE``) and broadcast; scoring streams every row once.

Edge cases: null, empty and wordless texts are one passage without words and get a score; without labels, or with labels
of one kind, the score is the labels' mean (0.5 without any); a null doc_id is scored as held out or not by the crc32
of empty text; rows that repeat a doc_id are each scored; an empty table gives no rows; ``score`` keeps
other columns, but replaces those named as its own, in any case. A score depends on the text alone, not on rows beside
it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .labelled import beside, sample
from .shared import fold, read_table, text_of
from .words import SPACED, Piece, grams, lists, pieces

SAMPLE = 6000  # labelled rows that the model is fitted on, at most
PASSAGE, PASSAGES = 64, 256  # words in a passage, and passages in a text: longer texts have longer passages
BUCKETS = 32
_MARKS = [b"!?", b"|", b"*#$%&@^~_=+<>\\{}[]", b".", b",", b":;()'\"-/", b"\n", b"\t "]
_KINDS = np.zeros((len(_MARKS) + 4, 256), bool)
for _i, _m in enumerate(_MARKS):
    _KINDS[_i, list(_m)] = True
_KINDS[-4, 65:91] = _KINDS[-3, 97:123] = _KINDS[-2, 48:58] = _KINDS[-1, 128:] = True
WIDTH = len(_KINDS) + 8 + BUCKETS


def passages(p: Piece) -> tuple[np.ndarray, np.ndarray]:
    """Row of each passage of a piece, and its encoding; a text without words is one passage."""
    n = np.diff(p.begin)
    size = np.maximum(PASSAGE, -(-n // PASSAGES))
    count = np.maximum(1, -(-n // size))
    row = np.repeat(np.arange(p.rows), count)
    k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    first = p.begin[row] + k * size[row]
    last = np.minimum(first + size[row], p.begin[row + 1])
    words, starts = len(p.hashes), np.append(p.start, 0)
    lo = np.where(k == 0, p.off[row], starts[np.minimum(first, words)])
    hi = np.where(last == p.begin[row + 1], p.off[row + 1], starts[np.minimum(last, words)])
    out = np.zeros((len(row), WIDTH), np.float32)
    size_b = np.maximum(hi - lo, 1)
    for i, kind in enumerate(_KINDS):
        total = np.concatenate([[0], np.cumsum(kind[p.raw])])
        out[:, i] = (total[hi] - total[lo]) / size_b
    length = (p.stop - p.start).astype(np.float64)
    many = np.maximum(last - first, 1)

    def mean(x: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(x)])
        return (total[last] - total[first]) / many

    def again(h: np.ndarray, of: np.ndarray) -> np.ndarray:  # occurrences after the first, which stays one whatever follows
        order = np.lexsort((h, of))
        same = (h[order][1:] == h[order][:-1]) & (of[order][1:] == of[order][:-1])
        old = np.zeros(len(h), bool)
        old[order[1:][same]] = True
        return old

    j = len(_KINDS)
    doc = p.doc()
    mine = np.repeat(np.arange(len(row)), last - first)
    out[:, j] = mean(length) / 10
    out[:, j + 1] = np.sqrt(np.maximum(mean(length**2) - mean(length) ** 2, 0)) / 10
    out[:, j + 2] = mean(length >= 15)
    out[:, j + 3] = mean(length <= 2)
    if words:
        out[:, j + 4] = mean(again(p.hashes, mine))
        four, whole = grams(p, 4)
        out[:, j + 5] = mean(again(four, doc) & whole)  # of the text's own four-word runs
    out[:, j + 6] = np.log1p(n[row]) / 10
    out[:, j + 7] = np.log1p(last - first) / 5
    bag = np.bincount(mine * BUCKETS + (p.hashes % np.uint64(BUCKETS)).astype(np.int64), minlength=len(row) * BUCKETS)
    out[:, j + 8 :] = np.sqrt(bag.reshape(-1, BUCKETS) / many[:, None])
    return row, out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    w: dict[str, np.ndarray] | None
    prior: float

    def score(self, x: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Of the documents whose passages are x[begin[i]:begin[i + 1]]."""
        if self.w is None:
            return np.full(len(begin) - 1, self.prior)
        return _forward(self.w, ((x - self.mean) * self.scale).clip(-6, 6), begin)[0]


def _forward(w: dict, x: np.ndarray, begin: np.ndarray) -> tuple:
    start, of = begin[:-1], np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    h = np.tanh(x @ w["E"] + w["e"])
    v, u = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
    s = (v * u) @ w["a"]
    s = np.exp(s - np.maximum.reduceat(s, start)[of])
    a = s / np.add.reduceat(s, start)[of]
    z = np.add.reduceat(a[:, None] * h, start)
    return 1 / (1 + np.exp(-(z @ w["b"] + w["c"]))), h, v, u, a, z, of


def gradients(w: dict, x: np.ndarray, begin: np.ndarray, y: np.ndarray) -> dict:
    """Of the mean log loss of the documents' labels, by back-propagation."""
    p, h, v, u, a, z, of = _forward(w, x, begin)
    g = (p - y) / len(y)
    gz = g[:, None] * w["b"]
    gh = a[:, None] * gz[of]
    ga = (gz[of] * h).sum(1)
    gs = a * (ga - np.add.reduceat(a * ga, begin[:-1])[of])
    gv, gu = gs[:, None] * w["a"] * u * (1 - v**2), gs[:, None] * w["a"] * v * u * (1 - u)
    gh += gv @ w["V"].T + gu @ w["U"].T
    gx = gh * (1 - h**2)
    return {"E": x.T @ gx, "e": gx.sum(0), "V": h.T @ gv, "U": h.T @ gu, "a": (v * u).T @ gs, "b": z.T @ g, "c": g.sum()}


def fit(x: np.ndarray, begin: np.ndarray, y: np.ndarray, width: int = 24, epochs: int = 30, batch: int = 128, rate: float = 4e-3, decay: float = 1e-4, seed: int = 7) -> Model:
    """Adam on the log loss of document labels; ``begin`` as in ``Model.score``."""
    prior = float(y.mean()) if len(y) else 0.5
    mean, scale = (x.mean(0), 1 / np.maximum(x.std(0), 1e-3)) if len(x) else (np.zeros(WIDTH), np.ones(WIDTH))
    if len(np.unique(y > 0.5)) < 2:
        return Model(mean, scale, None, prior)
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    w = {"E": rng.normal(0, d**-0.5, (d, width)), "e": np.zeros(width), "V": rng.normal(0, width**-0.5, (width, width)), "U": rng.normal(0, width**-0.5, (width, width)), "a": rng.normal(0, width**-0.5, width), "b": rng.normal(0, width**-0.5, width), "c": np.array(np.log((prior + 1e-3) / (1 - prior + 1e-3)))}
    m1, m2 = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    x = ((x - mean) * scale).clip(-6, 6)
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            docs = order[at : at + batch]
            size = begin[docs + 1] - begin[docs]
            cut = np.concatenate([[0], np.cumsum(size)])
            rows = np.repeat(begin[docs] - cut[:-1], size) + np.arange(cut[-1])
            xb = x[rows]
            grad = gradients(w, xb, cut, y[docs])
            step += 1
            now = rate * (1 - epoch / epochs)
            for k in w:
                gk = grad[k] + (decay * w[k] if k in "EVUab" else 0)
                m1[k] = 0.9 * m1[k] + 0.1 * gk
                m2[k] = 0.999 * m2[k] + 0.001 * gk**2
                w[k] = w[k] - now * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, w, prior)


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for p in pieces(batch.column(2), SPACED):
            row, x = passages(p)
            begin = np.searchsorted(row, np.arange(p.rows + 1)) * WIDTH
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(p.row, p.rows), batch.column(1).slice(p.row, p.rows), lists(x.ravel(), begin)], names=["doc_id", "y", "x"])


def train(docs: DataFrame, labels: DataFrame, mod: int = 3, held: int = 1, most: int = SAMPLE) -> Model:
    rows = sample(docs, labels, "quality", mod, held, most)
    kind = dict(docs.dtypes)["doc_id"]
    got = rows.mapInArrow(_encode, f"doc_id {kind}, y double, x array<float>").toPandas().sort_values("doc_id")
    x = [np.asarray(v, np.float32).reshape(-1, WIDTH) for v in got["x"]]
    begin = np.concatenate([[0], np.cumsum([len(v) for v in x])]).astype(np.int64)
    return fit(np.concatenate([np.zeros((0, WIDTH), np.float32), *x]), begin, got["y"].to_numpy(float))


def score(docs: DataFrame, model: Model, mod: int = 3, held: int = 1) -> DataFrame:
    """(doc_id, held_out, score, predicted) and ``docs``' other columns, of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers
    names = beside(docs, ("score", "held_out", "predicted", "_text"))
    rows = docs.select(*names, text_of().alias("_text"))

    def run(batches):
        for batch in batches:
            for p in pieces(batch.column(len(names)), SPACED):
                row, x = passages(p)
                s = shared.value.score(x, np.searchsorted(row, np.arange(p.rows + 1)))
                yield pa.RecordBatch.from_arrays([c.slice(p.row, p.rows) for c in batch.columns[:-1]] + [pa.array(s.astype(np.float64))], names=[*names, "score"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in docs.select(*names).dtypes)
    out = rows.mapInArrow(run, f"{kinds}, score double")
    return out.withColumns({"held_out": fold("doc_id", mod) == held, "predicted": (F.col("score") >= 0.5).cast("int")})


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, read_table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", "held_out", "score", "predicted")
