"""Alignment of two tokenizers' tokens over the same text, by the byte offsets at which tokens of both end.

An Arrow pipeline inside tasks: a batch's token lists are flattened with their parent indices, token lengths are summed up
within each text, and the ends, keyed by text and byte offset, meet in an Acero hash join. A match is a link between the
A and the B token that end there, and ends a group. ``Table.group_by`` counts the linked id pairs of each text and of
each block, a stretch of a task's input of bounded bytes; Spark merges the blocks' partial counts into corpus counts. Each
block's distinct pairs meet these in a join, and a block's texts read them there, so what is shuffled is one row for each
block and pair, and one row for each text.

Edge cases: null and empty texts have no tokens; neither have texts whose tokens of either kind, joined, aren't the
space and the text (such as those with U+2581); a text of any length is encoded whole in its task; rows that repeat a
doc_id are each aligned, a null doc_id is kept; pairs that are equally common are all best; an empty table gives no rows;
other columns are ignored."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import read_table, written
from .tokens import Encoder, PieceEncoder, default_path
from .words import buffers

STEP = 1 << 20  # bytes of text aligned at a time; a longer text is a step of its own
BLOCK = 24 << 20  # bytes of text in a block, about
B_BITS = 32  # a pair of ids is a * 2**B_BITS + b


def piece_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Side:
    """A tokenizer, and the bytes and lengths of its tokens."""

    def __init__(self, encoder, marks: str):
        self.encoder = encoder
        table = encoder.token_bytes()
        self.bytes, self.length = pa.array(table, pa.large_binary()), pa.array([len(x) for x in table], pa.int64())
        self.names = [f"{i}{mark}" for i in range(len(table)) for mark in marks]  # an id, and what follows it

    def tokens(self, texts: list[str]) -> pa.LargeListArray:
        found = [self.encoder.encode(" " + t) if t else b"" for t in texts]
        offsets = np.cumsum([0, *(len(x) // 4 for x in found)])
        return pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), pa.array(np.frombuffer(b"".join(found), "<u4"), pa.uint32()))


class Sides:
    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = Side(Encoder(path_a, plain=True), ",|"), Side(PieceEncoder(path_b), ",;")
        self.names = pa.array(self.a.names + self.b.names, pa.large_string())


@lru_cache(maxsize=1)
def sides(path_a: str, path_b: str) -> Sides:
    """One for each worker process."""
    return Sides(path_a, path_b)


def _whole(side: Side, tokens: pa.LargeListArray, texts: list[str]) -> np.ndarray:
    """Which texts are, after a space, the bytes of their tokens."""
    data, off = buffers_of(side.bytes.take(pc.list_flatten(tokens)))
    ends = off[np.asarray(tokens.offsets)]
    return np.array([bool(t) and data[i:j] == b" " + t.encode() for t, i, j in zip(texts, ends.tolist(), ends[1:].tolist())], bool)


def buffers_of(a: pa.Array) -> tuple[memoryview, np.ndarray]:
    """Bytes and offsets of a large binary or string array without nulls."""
    if isinstance(a, pa.ChunkedArray):
        a = a.combine_chunks()
    off = np.frombuffer(a.buffers()[1], np.int64, len(a) + 1, a.offset * 8) if len(a) else np.zeros(1, np.int64)
    return memoryview(a.buffers()[2] if len(a) and a.buffers()[2] is not None else b"").cast("B"), off


def _ends(side: Side, tokens: pa.LargeListArray, name: str) -> pa.Table:
    """(key, id, at): of each token its text and end, its id and its place among all tokens."""
    ids, text = pc.list_flatten(tokens), pc.cast(pc.list_parent_indices(tokens), pa.int64())
    summed = pc.cumulative_sum(side.length.take(ids))
    before = np.concatenate([[0], np.asarray(summed)])[np.asarray(tokens.offsets)[:-1]]  # at the start of each text
    end = pc.subtract(summed, pa.array(before).take(text))
    key = pc.add(pc.shift_left(text, pa.scalar(32, pa.int64())), end)
    return pa.table({"key": key, name: pc.cast(ids, pa.int64()), f"at_{name}": pa.array(np.arange(len(ids)))})


def _digests(names: pa.Array, first_b: int, ids: dict[str, np.ndarray], offsets: dict[str, np.ndarray], last: dict[str, np.ndarray]) -> list[str]:
    """Of each text, the sha256 of its groups as ``a1,a2|b1;...``; '' where it has no tokens."""
    n = len(ids["a"]) + len(ids["b"])
    order = np.zeros(n, np.int64)
    for x, other in (("a", "b"), ("b", "a")):
        group = np.searchsorted(last[x], np.arange(len(ids[x])))  # of each token
        earlier = np.concatenate([[0], last[other] + 1])[group + (x == "b")]  # tokens of the other kind before it
        is_last = np.zeros(len(ids[x]), np.int64)
        is_last[last[x]] = 1
        order[np.arange(len(group)) + earlier] = 2 * ids[x] + is_last + (first_b if x == "b" else 0)
    data, off = buffers_of(names.take(pa.array(order)))
    ends = off[offsets["a"] + offsets["b"]].tolist()
    return [hashlib.sha256(data[i : j - 1]).hexdigest() if j > i else "" for i, j in zip(ends, ends[1:])]


def align_batch(s: Sides, texts: list[str]) -> pa.Table:
    """Of each text: n_a, n_b, n_groups, groups_sha256, and its linked pairs of ids and how often it has each."""
    tokens = {"a": s.a.tokens(texts), "b": s.b.tokens(texts)}
    good = _whole(s.a, tokens["a"], texts) & _whole(s.b, tokens["b"], texts)
    if not good.all():
        texts = [t if ok else "" for t, ok in zip(texts, good)]
        tokens = {"a": s.a.tokens(texts), "b": s.b.tokens(texts)}
    a, b = _ends(s.a, tokens["a"], "a"), _ends(s.b, tokens["b"], "b")
    links = a.join(b, "key", join_type="inner", use_threads=False).sort_by("key")
    text = pc.shift_right(links["key"], pa.scalar(32, pa.int64()))
    pair = pc.add(pc.shift_left(links["a"], pa.scalar(B_BITS, pa.int64())), links["b"])
    counts = pa.table({"text": text, "pair": pair}).group_by(["text", "pair"], use_threads=False).aggregate([([], "count_all")]).sort_by("text")
    begin = np.searchsorted(np.asarray(counts["text"]), np.arange(len(texts) + 1))
    offsets = {x: np.asarray(t.offsets) for x, t in tokens.items()}
    sha = _digests(s.names, len(s.a.names), {"a": np.asarray(a["a"]), "b": np.asarray(b["b"])}, offsets, {x: np.asarray(links[f"at_{x}"]) for x in "ab"})
    column = lambda x: pa.LargeListArray.from_arrays(pa.array(begin, pa.int64()), x.combine_chunks()).cast(pa.list_(x.type))
    return pa.table({
        "n_a": np.diff(offsets["a"]), "n_b": np.diff(offsets["b"]), "n_groups": np.bincount(np.asarray(text), minlength=len(texts)),
        "groups_sha256": sha, "pairs": column(counts["pair"]), "times": column(counts["count_all"]),
    })


def _aligned(batches: Iterator[pa.RecordBatch], path_a: str, path_b: str) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (doc_id, block, and the columns of ``align_batch``)."""
    s, task, seen = sides(path_a, path_b), TaskContext.get(), 0
    number = task.partitionId() if task else 0
    for batch in batches:
        off = buffers(batch.column(1))[1]
        row = 0
        while row < batch.num_rows:
            last = max(row + 1, int(np.searchsorted(off, off[row] + STEP, "right")) - 1)
            t = align_batch(s, [x or "" for x in batch.column(1).slice(row, last - row).to_pylist()])
            block = pa.array(np.full(last - row, (number << 32) + seen // BLOCK))
            t = t.add_column(0, "doc_id", batch.column(0).slice(row, last - row)).add_column(1, "block", block)
            yield from t.combine_chunks().to_batches()
            seen += int(off[last] - off[row])
            row = last


def _flat(table: pa.Table | pa.RecordBatch) -> pa.Table:
    """(row, pair, n) of all linked pairs of some texts."""
    pairs, times = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (table["pairs"], table["times"]))
    return pa.table({"row": pc.cast(pc.list_parent_indices(pairs), pa.int64()), "pair": pc.list_flatten(pairs), "n": pc.list_flatten(times)})


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, pairs, times) to (block, pair, n), counted by batch."""
    for batch in batches:
        flat = _flat(batch)
        t = pa.table({"block": batch["block"].take(flat["row"].combine_chunks()), "pair": flat["pair"], "n": flat["n"]})
        t = t.group_by(["block", "pair"], use_threads=False).aggregate([("n", "sum")]).rename_columns(["block", "pair", "n"])
        yield from t.combine_chunks().to_batches()


def _counted(texts: pa.Table, found: pa.Table) -> pa.Table:
    """A block's texts, and the corpus counts of the pairs it has, to the result's rows."""
    links = _flat(texts).join(found.select(["pair", "count", "best"]), "pair", join_type="inner", use_threads=False)
    links = pa.table({"row": links["row"], "n_links": links["n"], "n_best": pc.multiply(links["n"], pc.cast(links["best"], pa.int64())), "count_sum": pc.multiply(links["n"], links["count"])})
    sums = links.group_by("row", use_threads=False).aggregate([(c, "sum") for c in ("n_links", "n_best", "count_sum")])
    row, out = np.asarray(sums["row"]), {}
    for c in ("n_links", "n_best", "count_sum"):
        out[c] = np.zeros(len(texts), np.int64)
        out[c][row] = np.asarray(sums[f"{c}_sum"])
    kept = ["doc_id", "n_a", "n_b", "n_groups"]
    return pa.table({**{c: texts[c] for c in kept}, **out, "groups_sha256": texts["groups_sha256"]})


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Alignments of every row, (doc_id, block, n_a, n_b, n_groups, groups_sha256, pairs, times); each block's pairs,
    (block, pair, n); and the corpus counts of linked pairs, (pair, a, b, count, best), ``best``: the highest of its B id."""
    path_a, path_b = path_a or default_path(), path_b or piece_path()
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(d.dtypes)["doc_id"]
    schema = f"doc_id {kind}, block long, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<long>, times array<long>"
    texts = written(d.mapInArrow(lambda b: _aligned(b, path_a, path_b), schema), "aligned")
    blocks = _block_counts(texts)
    return texts, blocks, _pair_counts(blocks)


def _block_counts(texts: DataFrame) -> DataFrame:
    partial = texts.select("block", "pairs", "times").mapInArrow(_partial, "block long, pair long, n long")
    return written(partial.groupBy("block", "pair").agg(F.sum("n").alias("n")), "blocks")


def _pair_counts(blocks: DataFrame) -> DataFrame:
    b = F.col("pair").bitwiseAND(F.lit((1 << B_BITS) - 1))
    counts = blocks.groupBy("pair").agg(F.sum("n").alias("count"))
    counts = written(counts.select("pair", F.shiftright("pair", B_BITS).alias("a"), b.alias("b"), "count"), "counts")
    most = counts.groupBy("b").agg(F.max("count").alias("most"))  # a row for each id of the vocabulary at most
    return counts.join(F.broadcast(most), "b").select("pair", "a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def link_counts(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row."""
    texts, blocks, counts = align(docs, path_a, path_b, id_col, text_col)
    found = blocks.join(counts.hint("merge"), "pair").select("block", "pair", "count", "best")
    kind = dict(texts.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return texts.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_counted, schema)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_counts(read_table(spark, sf_dir, "documents"))
