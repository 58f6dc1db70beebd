"""Benchmark decontamination by winnowing.

Of every window of 6 consecutive 5-grams, so of every 10 words, the smallest 5-gram hash is kept (the rightmost of
equal ones). A span of 10 words that a document shares with an item yields the same fingerprint in both, so none is
missed. Fingerprints travel with the words around them; the join of training and test fingerprints extends each match
to the 10-word windows that hold it and compares their words. Items of fewer than 10 words are fingerprinted whole.

A bitmap of bounded size, made from the items' fingerprints, screens the documents' before the join.

Edge cases: texts of any length are searched whole; a null doc_id is judged as any other; null or wordless texts have no words and are never contaminated; wordless items never occur; an item
without an id taints documents but isn't counted in n_items; rows that repeat a doc_id are each judged on their own
text; without items or documents nothing is contaminated, or nothing returned; other columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bitmap import bitmap, hit, xxhash64_of
from .shared import read_table, row_key, text_of, written
from .words import ALNUM, Piece, grams, lists, pieces, signed

SPAN, K = 10, 5  # words in a window, words in a gram
W = SPAN - K + 1  # grams in a window
AROUND = SPAN + W - 1  # words that travel with a fingerprint: every window that holds its gram
_MARKS = "fp array<long>, m array<int>, pos array<int>, around array<long>"


def winnow(p: Piece) -> np.ndarray:
    """Positions of the 5-grams that some window of 10 words keeps."""
    g, _ = grams(p, K)
    _, whole = grams(p, SPAN)
    n = len(g) - W + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low, at = g[W - 1 :].copy(), np.full(n, W - 1)
    for i in range(W - 2, -1, -1):
        less = g[i : i + n] < low
        low[less] = g[i : i + n][less]
        at[less] = i
    return np.unique((np.arange(n) + at)[whole[:n]])


def _marks(p: Piece, short: list[int], whole_items: bool, shared=None) -> tuple[np.ndarray, ...]:
    """Fingerprints of a piece: row, hash, length, position in its text, words around it (0 outside the text)."""
    doc, n = p.doc(), len(p.hashes)
    found = []
    at = winnow(p)
    found.append((at, grams(p, K)[0][at], SPAN))
    for m in short:
        g, ok = grams(p, m)
        at = np.flatnonzero(ok & (np.diff(p.begin)[doc] == m)) if whole_items else np.flatnonzero(ok)
        found.append((at, g[at], m))
    at, fp = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
    m = np.concatenate([np.full(len(x[0]), x[2], np.int32) for x in found])
    if shared is not None:
        ok = hit(shared, xxhash64_of(fp))
        at, fp, m = at[ok], fp[ok], m[ok]
    order = np.argsort(at, kind="stable")
    at, fp, m = at[order], fp[order], m[order]
    rows = doc[at]
    here = at[:, None] + np.arange(AROUND) - (W - 1)
    inside = (here >= p.begin[rows][:, None]) & (here < p.begin[rows + 1][:, None])
    around = np.where(inside, p.hashes[np.clip(here, 0, max(n - 1, 0))] if n else np.uint64(0), np.uint64(0))
    return rows, fp, m, at - p.begin[rows], around


def _sketch(batches: Iterator[pa.RecordBatch], short: list[int], whole_items: bool, shared=None) -> Iterator[pa.RecordBatch]:
    """Replace the last column, text, with n_words and fingerprints."""
    for batch in batches:
        for p in pieces(batch.column(batch.num_columns - 1), ALNUM):
            rows, fp, m, pos, around = _marks(p, short, whole_items, shared)
            begin = np.searchsorted(rows, np.arange(p.rows + 1))
            yield pa.RecordBatch.from_arrays(
                [c.slice(p.row, p.rows) for c in batch.columns[:-1]]
                + [pa.array(np.diff(p.begin).astype(np.int64)), lists(signed(fp), begin), lists(m.astype(np.int32), begin), lists(pos.astype(np.int32), begin), lists(signed(around.ravel()), begin * AROUND)],
                names=[*batch.schema.names[:-1], "n_words", "fp", "m", "pos", "around"],
            )


def _spread(df: DataFrame, keep: list[str], prefix: str) -> DataFrame:
    one = df.select(*keep, "m", "pos", "around", F.posexplode("fp").alias("i", "fp"))
    return one.select(*keep, "fp", F.expr("m[i]").alias("m"), F.expr("pos[i]").alias(f"{prefix}pos"), F.expr(f"slice(around, i * {AROUND} + 1, {AROUND})").alias(f"{prefix}around"))


def hits(documents: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, n_words) of every document, and (doc_id, key, start, stop, items), the windows that occur in
    it, each with a list of structs of item_id.

    ``documents`` has doc_id and text, ``items`` has item_id and text. ``key`` is that of ``row_key``, which tells apart
    rows that repeat a doc_id."""
    short = [*range(1, SPAN)]
    src = items.select("item_id", text_of().alias("text"))
    marks = written(src.mapInArrow(lambda b: _sketch(b, short, True), f"item_id {dict(items.dtypes)['item_id']}, n_words long, {_MARKS}"), "items")
    short = sorted(r[0] for r in marks.where(F.col("n_words").between(1, SPAN - 1)).select(F.col("n_words").cast("int")).distinct().collect())
    test = _spread(marks, ["item_id"], "i")
    shared = bitmap(test.select("fp").distinct(), "fp")
    d = documents.select("doc_id", row_key().alias("key"), text_of().alias("text"))
    schema = f"doc_id {dict(documents.dtypes)['doc_id']}, key string, n_words long, {_MARKS}"
    train = written(d.mapInArrow(lambda b: _sketch(b, short, False, shared.value), schema), "fingerprints")
    # Items with the same words around a fingerprint are met once, as a list.
    test = test.groupBy("fp", "m", "iaround").agg(F.collect_set(F.struct("item_id")).alias("items"))
    both = _spread(train, ["doc_id", "key"], "d").distinct().join(test, ["fp", "m"])
    same = [f"IF(NOT array_contains(slice(daround, {o + 1}, {SPAN}), 0L) AND slice(daround, {o + 1}, {SPAN}) = slice(iaround, {o + 1}, {SPAN}), dpos - {W - 1 - o}, NULL)" for o in range(W)]
    starts = f"IF(m = {SPAN}, array_compact(array({', '.join(same)})), IF(slice(daround, {W}, m) = slice(iaround, {W}, m), array(dpos), array()))"
    found = both.select("doc_id", "key", "items", "m", F.explode(F.expr(starts)).alias("start"))
    return train.select("doc_id", "key", "n_words"), found.select("doc_id", "key", "items", "start", (F.col("start") + F.col("m")).alias("stop"))


def decontaminate(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Per document: n_words, n_hit (words inside windows that occur), n_items, item_ids, spans, contaminated."""
    train, found = hits(documents, items)
    ids = F.transform(F.array_distinct(F.flatten(F.collect_set("items"))), lambda x: x["item_id"].cast("string"))
    per = found.groupBy("doc_id", "key").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("s"), F.array_sort(F.array_distinct(F.array_compact(ids))).alias("item_ids"))
    merged = """aggregate(s, array(struct(-1 AS start, -1 AS stop)), (a, x) ->
      IF(x.start <= element_at(a, -1).stop, concat(slice(a, 1, size(a) - 1), array(struct(element_at(a, -1).start AS start, greatest(element_at(a, -1).stop, x.stop) AS stop))), concat(a, array(x))))"""
    per = per.select("doc_id", "key", "item_ids", F.expr(f"slice({merged}, 2, 1 << 30)").alias("spans"))
    out = train.alias("t").join(per.alias("p"), F.col("t.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("t.key") == F.col("p.key")), "left")
    hit_words = F.coalesce(F.expr("aggregate(spans, 0L, (a, x) -> a + x.stop - x.start)"), F.lit(0))
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return out.select("t.doc_id", "t.key", "n_words", hit_words.cast("long").alias("n_hit"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"), "spans", (hit_words > 0).alias("contaminated"))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return got.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "item_ids").cast("binary"), 256).alias("items_sha256"), "contaminated")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[s:s + least(10, len(w)) - 1], ' ') AS g
  FROM i, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS t(s) WHERE len(w) > 0),
dw AS (SELECT rid, m, s, array_to_string(w[s:s + m - 1], ' ') AS g FROM d, (SELECT DISTINCT m FROM iw) AS ms, unnest(range(1, len(w) - m + 2)) AS t(s)),
h AS (SELECT DISTINCT rid, s, dw.m AS m, item_id FROM dw JOIN iw ON dw.m = iw.m AND dw.g = iw.g),
c AS (SELECT rid, count(DISTINCT p) AS n FROM h, unnest(range(s, s + m)) AS u(p) GROUP BY rid),
x AS (SELECT rid, count(*) AS n, string_agg(k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS k FROM h) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(x.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN x USING (rid)
"""
