"""Best-fit packing of token pieces into sequences, by exact complements over a histogram of lengths.

The plan depends on the number of pieces of each length only, at most as many numbers as a sequence has tokens, so it is
made on the driver at any size of the corpus: for every length, longest first, single, pair and triple sums that exactly
fill its gap are consumed as long as all their lengths are available; best fit places the rest. The plan has patterns of
lengths with multiplicities. Spark then ranks the pieces of each length (in salted groups, so that a length that many
pieces share is spread) and each piece looks its place up by length and rank.

Edge cases: null text counts as empty, and an empty text is the one end token; a text of any length is cut, never
dropped; rows that repeat a doc_id are packed each; a null doc_id is kept; an empty table gives no rows; other columns
are ignored."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import read_table, text_of, written
from .tokens import default_path, encoder

ROOM, END = 1024, 2
Pattern = tuple[tuple[int, ...], int]


def cut(ids: bytes, room: int = ROOM) -> list[tuple[int, bytes]]:
    """(start, ids) of the pieces: all but the first are full."""
    n, width = len(ids) // 4, 4
    first = n - (max(1, -(-n // room)) - 1) * room
    at = [0, *range(first, n, room)]
    return [(a, ids[a * width : b * width]) for a, b in zip(at, [*at[1:], n])]


def token_pieces(batches: Iterator[pa.RecordBatch], path: str, room: int, end: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, row, text) to (doc_id, row, piece, start, length, ids_crc32)."""
    encode, last = encoder(path).encode, np.array([end], "<u4").tobytes()
    for batch in batches:
        rows, out = [], []
        for i, text in enumerate(batch.column(2)):
            for k, (start, ids) in enumerate(cut(encode(text.as_py()) + last, room)):
                rows.append(i)
                out.append((k, start, len(ids) // 4, zlib.crc32(ids)))
        num = np.array(out, np.int64).reshape(-1, 4)
        at = pa.array(np.array(rows, np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(num[:, 0].astype(np.int32)), *(pa.array(np.ascontiguousarray(num[:, i])) for i in (1, 2, 3))], names=["doc_id", "row", "piece", "start", "length", "ids_crc32"])


#: Shares of every length that exact complements leave to best fit, which needs short pieces to fill up with.
HELD_BACK = (0, 0.1, 0.25, 0.5, 0.75, 0.9)


def plan(counts: dict[int, int], room: int = ROOM) -> list[Pattern]:
    """Patterns of lengths, and how often each is used, that hold ``counts[length]`` pieces of each length.

    The share held back for best fit is the one that needs the fewest sequences."""
    plans = [_plan(counts, room, share) for share in HELD_BACK]
    return min(plans, key=lambda p: sum(m for _, m in p))


def _plan(counts: dict[int, int], room: int, share: float) -> list[Pattern]:
    left, held = np.zeros(room + 1, np.int64), np.zeros(room + 1, np.int64)
    for length, n in counts.items():
        held[length] = int(n * share) if length < room else 0
        left[length] = n - held[length]
    out: list[Pattern] = []

    def use(*lengths: int) -> None:
        need = {x: lengths.count(x) for x in lengths}
        m = int(min(left[x] // k for x, k in need.items()))
        if m > 0:
            for x, k in need.items():
                left[x] -= m * k
            out.append((lengths, m))

    def pair(total: int, most: int) -> tuple[int, int] | None:
        """The pair of available lengths with this sum whose larger one is the largest, if any."""
        hi = np.arange(min(most, total - 1), (total - 1) // 2, -1)
        ok = np.flatnonzero((left[hi] > 0) & (left[total - hi] > 0) & ((hi * 2 != total) | (left[hi] > 1)))
        return (int(hi[ok[0]]), int(total - hi[ok[0]])) if len(ok) else None

    if left[room]:
        use(room)
    lengths = range(room - 1, 0, -1)
    for a in lengths:
        if left[a]:
            use(a, room - a)
    for a in lengths:
        top = min(room - a - 1, a)
        while left[a] > 0 and top > 0 and (p := pair(room - a, top)):
            use(a, *p)
            if _free(left, a, *p) <= 0:
                top = p[0] - 1
    for a in lengths:
        gap = room - a
        for b in np.flatnonzero(left[1 : min(gap - 1, a + 1)])[::-1] + 1:
            top = min(int(b), gap - int(b) - 1)
            while left[a] > 0 and left[b] > 0 and top > 0 and (p := pair(gap - int(b), top)):
                use(a, int(b), *p)
                if _free(left, a, int(b), *p) <= 0:
                    top = p[0] - 1
            if left[a] <= 0:
                break
    return out + _best_fit(left + held, room)


def _free(left: np.ndarray, *lengths: int) -> int:
    """How often this combination is still available."""
    return int(min(left[x] // lengths.count(x) for x in lengths))


def _best_fit(left: np.ndarray, room: int) -> list[Pattern]:
    """Longest first, into the fullest sequences with room; sequences of equal content are handled together."""
    open_: dict[int, dict[tuple[int, ...], int]] = {}
    gaps: list[int] = []

    def add(what: tuple[int, ...], m: int) -> None:
        gap = room - sum(what)
        if gap not in open_:
            open_[gap] = {}
            insort(gaps, gap)
        open_[gap][what] = open_[gap].get(what, 0) + m

    for a in range(room, 0, -1):
        n = int(left[a])
        while n > 0:
            i = bisect_left(gaps, a)
            if i == len(gaps):
                each = room // a
                if n >= each:
                    add((a,) * each, n // each)
                if n % each:
                    add((a,) * (n % each), 1)
                break
            gap = gaps[i]
            what, m = open_[gap].popitem()
            each = min(gap // a, n)
            take = min(m, n // each)
            if take < m:
                open_[gap][what] = m - take
            if not open_[gap]:
                del open_[gap]
                gaps.pop(i)
            add(what + (a,) * each, take)
            n -= take * each
    return [x for kinds in open_.values() for x in kinds.items()]


def places(patterns: list[Pattern]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first ranks, and the first sequence and the offset that the ranks from there on get."""
    got: dict[int, list[tuple[int, int, int]]] = {}
    seen: dict[int, int] = {}
    base = 0
    for lengths, m in patterns:
        offset = 0
        for x in lengths:
            got.setdefault(x, []).append((seen.get(x, 0), base, offset))
            seen[x] = seen.get(x, 0) + m
            offset += x
        base += m
    return {x: tuple(np.array(v, np.int64).T) for x, v in got.items()}


def pack(pieces: DataFrame, room: int = ROOM) -> DataFrame:
    """Add sequence_id and offset to pieces; they have a ``length`` and are told apart by ``doc_id``, ``row`` and ``piece``."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``room`` rows
    at = spark.sparkContext.broadcast(places(plan(counts, room)))
    salts = max(64, sum(counts.values()) // 2_000_000)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "row", "piece"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    first = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "row", "piece")
    ranked = salted.withColumn("rank", F.row_number().over(order)).join(first, ["length", "salt"]).withColumn("rank", F.col("rank") - 1 + F.col("first"))
    ranked = ranked.select(*pieces.columns, F.col("rank").cast("long").alias("rank"))

    def place(batches):
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length):
                mine = np.flatnonzero(length == x)
                start, base, offset = at.value[int(x)]
                i = np.searchsorted(start, rank[mine], "right") - 1
                seq[mine], off[mine] = base[i] + rank[mine] - start[i], offset[i]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(seq), pa.array(off)], names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in pieces.dtypes)
    return ranked.mapInArrow(place, f"{kinds}, sequence_id long, `offset` long")


def best_fit_pack(docs: DataFrame, path: str | None = None, room: int = ROOM, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise and cut every whole text and pack the pieces: (doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    path = path or default_path()
    d = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_of(text_col)).alias("row"), text_of(text_col).alias("text"))
    kind = dict(d.dtypes)["doc_id"]
    t = written(d.mapInArrow(lambda b: token_pieces(b, path, room, end), f"doc_id {kind}, row long, piece int, start long, length long, ids_crc32 long"), "pieces")
    return pack(t, room).drop("row")


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_pack(read_table(spark, sf_dir, "documents"))
