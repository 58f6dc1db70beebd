"""LM scoring with a probabilistic suffix tree (Ron, Singer and Tishby 1996) over a text's words.

A text is its lower-cased words, then one end. The root has every training word by its count; contexts of one to ``DEEP``
words are further states, each smoothed towards the state of its suffix. Grams, a context and the word or end after it,
are counted in shuffled tables. A gram seen ``SEEN`` times can only be so common if its parts are, and a bitmap of those
(no false negatives) decides what is counted; so states grow with the corpus. With its count a gram gets the smallest
source of its texts, one of 256, and only texts of this source tell what its parts are, so these rows grow with the grams. Divergence tests decide what is
retained: a follower if the gain of its own share over that in the suffix's distribution pays for a parameter
(half the logarithm of all tokens), and a context if the gain of all its followers, the others together being one more,
does. A word is scored by the longest state that precedes it: c / (n + ALPHA) for a retained follower, and what the state
leaves to others times the share in its suffix. To the root as many unknown words are added as words were seen once; all
unknown words are one event, as in the unigram base.

Each step's result is written, and its shuffles are dropped before the next one, so disk holds one step's at a time.
No word, state or count passes through the driver: texts, dealt to blocks of bounded bytes, ask for the distinct words and
grams that they have, and one join finds these. Questions and answers of a block and a range of keys are one row: sorted
keys as differences, counts as numbers, each in no more bytes than its largest needs.

Edge cases: null counts as empty, and an empty text is one end; texts of any length are read whole; rows that repeat a
doc_id are each scored; a null doc_id's fold is that of empty text; equally common words or contexts are all treated
alike; without training texts the base is 0 and every word the one unknown event; an empty table gives no rows; other
columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bitmap import bitmap, done, hit, xxhash64_of
from .shared import fold, read_table, scratch, settled, text_of
from .words import SPACED, Piece, mix, pieces, signed

U64 = np.uint64
DEEP, SEEN = 3, 8
ALPHA = 2.0  # weight of the suffix state's distribution, in tokens
ENDED = U64(0xA24BAED4963EE407)  # stands for the end of a text
STEP = 1 << 19  # bytes of text whose words a task hashes at a time
SENT = 1 << 16  # rows of a batch that a task sends: the JVM holds each whole, outside its heap
BLOCK = 24 << 20  # bytes of text in a block, about
HELD = 1 << 20  # keys that a task collects before it sends them
_OTHER = 0x5851F42D4C957F2D


class Lookup:
    """Row numbers of distinct 64-bit keys, by open addressing over arrays."""

    def __init__(self, keys: np.ndarray):
        keys = np.asarray(keys).astype(U64)
        self.mask = U64((1 << max(4, int(2 * len(keys)).bit_length())) - 1)
        self.keys, self.none = keys, len(keys)
        self.at = np.full(int(self.mask) + 1, len(keys), np.int64)
        at, left = mix(keys) & self.mask, np.arange(len(keys))
        while len(left):
            free = self.at[at[left]] == self.none
            _, first = np.unique(at[left][free], return_index=True)
            put = left[free][first]
            self.at[at[put]] = put
            left = left[self.at[at[left]] != left]
            at[left] = (at[left] + U64(1)) & self.mask

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, or the number of rows."""
        out = np.full(len(keys), self.none)
        at, left, known = mix(keys) & self.mask, np.arange(len(keys)), np.append(self.keys, U64(0))
        while len(left):
            row = self.at[at[left]]
            same = (row < self.none) & (known[row] == keys[left])
            out[left[same]] = row[same]
            left = left[~same & (row < self.none)]
            at[left] = (at[left] + U64(1)) & self.mask
        return out


def runs(p: Piece) -> tuple[list[np.ndarray], np.ndarray]:
    """For every word of some texts and the end after each: hashes of the last 1 to DEEP + 1 of them, and how many
    precede it in its text. A word's own hash is that of the word table."""
    size = np.diff(p.begin) + 1
    last = np.cumsum(size) - 1
    flat = np.empty(int(size.sum()), U64)
    word = np.ones(len(flat), bool)
    word[last] = False
    flat[word], flat[last] = p.hashes, ENDED
    g = [flat]
    for _ in range(DEEP):
        longer = np.zeros(len(flat), U64)
        longer[1:] = mix(g[-1][:-1] * U64(0xD6E8FEB86659FD93) + flat[1:])
        g.append(longer)
    return g, np.arange(len(flat)) - np.repeat(last + 1 - size, size)


def screen(keys: DataFrame) -> tuple:
    """Two bitmaps of the column ``key``, by independent hashes: few grams pass that aren't in it."""
    return bitmap(keys, "key"), bitmap(keys.select(F.col("key").bitwiseXOR(F.lit(_OTHER)).alias("key")), "key")


def _seen(shared: tuple, keys: np.ndarray) -> np.ndarray:
    here = hit(shared[0].value, xxhash64_of(keys))
    here[here] = hit(shared[1].value, xxhash64_of(keys[here] ^ U64(_OTHER)))
    return here


def _firsts(x: np.ndarray) -> np.ndarray:
    """A place of each distinct value."""
    order = np.argsort(x)
    new = np.ones(len(x), bool)
    new[1:] = x[order[1:]] != x[order[:-1]]
    return order[new]


def _after(here: np.ndarray) -> np.ndarray:
    """Whether a position and the one before it are marked."""
    return here & np.concatenate([[False], here[:-1]])


def _sent(*columns: tuple[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    whole = pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for _, x in columns], names=[n for n, _ in columns])
    for at in range(0, whole.num_rows, SENT):
        yield whole.slice(at, SENT)


def _counted(batches: Iterator[pa.RecordBatch], pick) -> Iterator[pa.RecordBatch]:
    """Texts to (key, c), what ``pick`` takes of their words' hashes and runs, combined by batch."""
    for batch in batches:
        keys = [np.zeros(0, np.int64), *[signed(x) for p in pieces(batch.column(0), SPACED, STEP) for x in pick(p)]]
        key, c = np.unique(np.concatenate(keys), return_counts=True)
        yield from _sent(("key", key), ("c", c))


def _counts(texts: DataFrame, pick) -> DataFrame:
    return texts.select("text").mapInArrow(lambda b: _counted(b, pick), "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))


def source(p: Piece) -> np.ndarray:
    """A number from 0 to 255 for each text, by its words."""
    total = np.concatenate([np.zeros(1, U64), np.cumsum(p.hashes, dtype=U64)])
    return (mix(total[p.begin[1:]] - total[p.begin[:-1]]) >> U64(56)).astype(np.int64)


def _sources(p: Piece) -> np.ndarray:
    """The same for every word and end, as in ``runs``."""
    return np.repeat(source(p), np.diff(p.begin) + 1)


def _located(batches: Iterator[pa.RecordBatch], pick) -> Iterator[pa.RecordBatch]:
    """Texts to (key, c, src), as ``_counted``, ``src`` being the smallest source of a text that has the key; ``pick`` gives
    hashes and where to take them."""
    for batch in batches:
        got = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for p in pieces(batch.column(0), SPACED, STEP):
            src = _sources(p)
            got += [(signed(x[at]), src[at]) for x, at in pick(p)]
        key, src = (np.concatenate(x) for x in zip(*got))
        order = np.argsort(key)
        key = key[order]
        begin = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        low = np.minimum.reduceat(src[order], begin) if len(begin) else src
        yield from _sent(("key", key[begin]), ("c", np.diff(np.append(begin, len(key)))), ("src", low))


def _located_counts(texts: DataFrame, pick) -> DataFrame:
    return texts.select("text").mapInArrow(lambda b: _located(b, pick), "key long, c long, src long").groupBy("key").agg(F.sum("c").alias("c"), F.min("src").alias("src"))


def _at(keys, src):
    """A key as texts of a source have it; a bijection of keys, of arrays or columns."""
    step = 0x2545F4914F6CDD1D >> 8
    return keys ^ ((src + 1).astype(U64) * U64(step)) if isinstance(keys, np.ndarray) else keys.bitwiseXOR((src + 1) * F.lit(step))


def _parts(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """(key, ctx, low, up, d) of common grams: the context, the gram without its first word, and the context without; from
    the texts of the gram's smallest source, once, but for what a task can't hold."""
    got, size = [np.zeros((0, 5), np.int64)], 0

    def distinct():
        rows = np.concatenate(got)
        return rows[_firsts(rows[:, 0])]

    def batch_of(rows):
        return _sent(*zip(("key", "ctx", "low", "up", "d"), rows.T))

    for batch in batches:
        for p in pieces(batch.column(0), SPACED, STEP):
            g, k = runs(p)
            src = _sources(p)
            for d in range(1, DEEP + 1):
                at = np.flatnonzero(k >= d)
                at = at[_seen(shared, _at(g[d][at], src[at]))]
                at = at[_firsts(g[d][at])]
                up = signed(g[d - 2][at - 1]) if d > 1 else np.zeros(len(at), np.int64)
                got.append(np.stack([signed(g[d][at]), signed(g[d - 1][at - 1]), signed(g[d - 1][at]), up, np.full(len(at), d)], 1))
                size += len(at)
            if size > HELD // 2:
                got = [distinct()]
                size = len(got[0])
                if size > HELD // 4:
                    yield from batch_of(got[0])
                    got, size = [np.zeros((0, 5), np.int64)], 0
    yield from batch_of(distinct())


def grams(texts: DataFrame, ones: DataFrame) -> DataFrame:
    """(key, c, src) of the grams of two words and more that are seen SEEN times, from those of one word."""
    common = lambda d: d.where(F.col("c") >= SEEN)
    one = screen(ones)

    def two(p):
        g, k = runs(p)
        return [(g[1], np.flatnonzero(_after(_seen(one, g[0])) & (k >= 1)))]

    pairs = settled(common(_located_counts(texts, two)), "pairs")
    done(*one)
    pair = screen(pairs)

    def longer(p):
        g, k = runs(p)
        three = _after(_seen(pair, g[1]) & (k >= 1)) & (k >= 2)
        return [(g[2], np.flatnonzero(three)), (g[3], np.flatnonzero(_after(three) & (k >= 3)))]

    more = settled(common(_located_counts(texts, longer)), "grams")
    done(*pair)
    return pairs.unionByName(more)


def states(texts: DataFrame, words: DataFrame, tokens: int, docs: int) -> DataFrame:
    """(key, c, n, rest): a retained follower's count and its context's, by the hash of the gram, and a state's count and what
    of it isn't retained, by the hash of its words; null for what a row isn't about."""
    ends = texts.sparkSession.createDataFrame([(int(ENDED.astype(np.int64)), docs)], "key long, c long")
    ones = words.unionByName(ends).where(F.col("c") >= SEEN)
    many = grams(texts, ones)
    shared = screen(many.select(_at(F.col("key"), F.col("src")).alias("key")))
    many = many.select("key", "c")
    parts = texts.select("text").mapInArrow(lambda b: _parts(b, shared), "key long, ctx long, low long, up long, d long")
    parts = parts.groupBy("key").agg(*[F.first(c).alias(c) for c in ("ctx", "low", "up", "d")])
    named = lambda c, n: ones.unionByName(many).select(F.col("key").alias(c), F.col("c").alias(n)).hint("merge")
    rows = parts.join(many.hint("merge"), "key").join(named("low", "pc"), "low").drop("low").join(named("up", "pn"), "up", "left").drop("up")
    rows = rows.withColumn("pn", F.when(F.col("d") == 1, F.lit(tokens)).otherwise(F.col("pn"))).join(named("ctx", "n"), "ctx")
    c, n, pc, pn = (F.col(x) for x in ("c", "n", "pc", "pn"))
    gain = c * F.log(c * pn / (n * pc))
    price = float(np.log(max(tokens, 2)))
    rows = settled(rows.withColumn("gain", gain).where(2 * F.col("gain") > price), "followers")
    done(*shared)
    sums = rows.groupBy("ctx").agg(F.sum("gain").alias("g"), F.sum("c").alias("kept"), F.sum("pc").alias("pkept"), F.count("*").alias("k"), F.first("n").alias("n"), F.first("pn").alias("pn"))
    rest, prest = F.col("n") - F.col("kept"), F.col("pn") - F.col("pkept")
    g2 = 2 * (F.col("g") + F.when((rest > 0) & (prest > 0), rest * F.log(rest * F.col("pn") / (F.col("n") * prest))).otherwise(0.0))
    kept = sums.where(g2 > F.col("k") * price).select("ctx", "n", rest.alias("rest"))
    none = F.lit(None).cast("long")
    entries = rows.join(kept.select("ctx").hint("merge"), "ctx", "left_semi").select("key", "c", "n", none.alias("rest"))
    return entries.unionByName(kept.select(F.col("ctx").alias("key"), F.col("n").alias("c"), none.alias("n"), "rest"))


@dataclass
class Totals:
    n: int  # tokens, ends included
    v: int  # distinct ones
    texts: int
    once: int  # words seen once

    def root(self, c: np.ndarray) -> np.ndarray:
        """The share that a word with training count c has in the root."""
        unknown = max(self.once, 1)
        return np.where(c > 0, c, unknown) / (self.n + unknown)


def fit(texts: DataFrame) -> tuple[DataFrame, Totals]:
    """(key, c, n, rest) of every training word and retained gram, see ``states``, and the corpus totals, from rows with a
    ``text``."""
    since = scratch()
    words = settled(_counts(texts, lambda p: [p.hashes]), "words")
    v, n, once = words.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") == 1)).first()
    docs = texts.count()
    totals = Totals(int(n + docs), int(v + (docs > 0)), int(docs), int(once))
    none = F.lit(None).cast("long")
    both = words.select("key", "c", none.alias("n"), none.alias("rest")).unionByName(states(texts, words, totals.n, totals.texts))
    return settled(both.groupBy("key").agg(*[F.max(x).alias(x) for x in ("c", "n", "rest")]), "states", since), totals


def packed(x: np.ndarray) -> bytes:
    """Numbers from 0 on: how many bytes the largest has, then the first byte of each, the second, and so on, as counts have
    few large ones and those bytes are alike."""
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return bytes([width]) + np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unpacked(b) -> np.ndarray:
    flat = np.frombuffer(b, np.uint8)
    out = np.zeros(((len(flat) - 1) // int(flat[0]), 8), np.uint8)
    out[:, : int(flat[0])] = flat[1:].reshape(int(flat[0]), -1).T
    return out.view("<u8").ravel()


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted signed keys: the first one, then differences."""
    return keys[:1].tobytes() + packed(np.diff(keys.view(U64)))


def unpacked_keys(b) -> np.ndarray:
    first = np.frombuffer(b, U64, 1)
    return np.cumsum(np.concatenate([first, unpacked(memoryview(b)[8:])]), dtype=U64).view(np.int64)


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The range, of ``buckets``, that each signed key is in."""
    return (((keys >> 32) + (1 << 31)) * buckets) >> 32


def _asked(batches: Iterator[pa.RecordBatch], shared, buckets: int) -> Iterator[pa.RecordBatch]:
    """(block, text), sorted by block, to (block, bucket, keys): the distinct words of each block, and its grams that may be
    in the tree; each once, but for what a task can't hold."""
    now, held, new, size = None, np.zeros(0, np.int64), [], 0

    def batch_of():
        cuts = np.searchsorted(_bucket(held, buckets), np.arange(buckets + 1))
        some = np.flatnonzero(np.diff(cuts))
        for at in some.tolist():
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([at], pa.int64()), pa.array([packed_keys(held[cuts[at] : cuts[at + 1]])], pa.binary())], names=["block", "bucket", "keys"])

    for batch in batches:
        block = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
        for at, stop in zip(cuts, cuts[1:]):
            if stop > at and block[at] != now:
                held = np.unique(np.concatenate([held, *new]))
                yield from batch_of()
                now, held, new, size = int(block[at]), held[:0], [], 0
            for p in pieces(batch.column(1).slice(at, stop - at), SPACED, STEP):
                g, k = runs(p)
                for d, x in enumerate(g):
                    x = x[k >= d]
                    new.append(np.unique(signed(x[_seen(shared, x)] if d else x)))
                    size += len(new[-1])
                if size > 2 * HELD:
                    held, new, size = np.unique(np.concatenate([held, *new])), [], 0
                    if len(held) > 2 * HELD:
                        yield from batch_of()
                        held = held[:0]
    held = np.unique(np.concatenate([held, *new]))
    yield from batch_of()


def _answered(asked: pa.Table, table: pa.Table) -> pa.Table:
    """(block, keys) of a bucket, and its rows (key, c, n, rest), to (block, keys, c, n, rest) of those that are found; n and
    rest are one more, or 0 where there is none."""
    key = table.column("key").to_numpy()
    order = np.argsort(key)
    key, values = key[order], [np.nan_to_num(table.column(x).to_numpy(zero_copy_only=False), nan=-1).astype(np.int64)[order] for x in ("c", "n", "rest")]
    values[1:] = [x + 1 for x in values[1:]]
    out: list[list] = [[], [], [], [], []]
    for block, b in zip(asked.column("block").to_pylist(), asked.column("keys")):
        want = unpacked_keys(b.as_buffer())
        at = np.searchsorted(key, want)
        at = at[np.append(key, 0)[at] == want] if len(key) else at[:0]
        at = at[at < len(key)]
        if len(at):
            for column, x in zip(out, (block, packed_keys(key[at]), *(packed(v[at]) for v in values))):
                column.append(x)
    return pa.table([pa.array(x, pa.binary() if i else pa.int64()) for i, x in enumerate(out)], names=["block", "keys", "c", "n", "rest"])


def folded(g: list[np.ndarray], k: np.ndarray, a: list[np.ndarray], b: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A and B of each position: its probability is A + B times that of the root. ``a[d]`` and ``b[d]`` are those of
    the gram of d + 1 words that ends at a position, NaN where it has none."""
    A, B = np.zeros(len(k)), np.ones(len(k))
    for d in range(1, len(g)):
        left = np.concatenate([[np.nan], b[d - 1][:-1]])
        left = np.where((k >= d) & ~np.isnan(left), left, 1.0)
        A = A * left + np.where((k >= d) & ~np.isnan(a[d]), a[d], 0.0)
        B *= left
    return A, B


def _score(m: Totals, texts: pa.Table, found: pa.Table, alpha: float = ALPHA) -> pa.Table:
    """A block of (doc_id, held_out, block, text), and (block, keys, c, n, rest) of what it asked for, to the result's
    rows."""
    all_ = lambda name, of: np.concatenate([np.zeros(0, np.int64), *[of(b.as_buffer()).view(np.int64) for b in found.column(name)]])
    index = Lookup(all_("keys", unpacked_keys).view(U64))
    c, n, rest = (all_(x, unpacked) for x in ("c", "n", "rest"))
    a = np.append(np.where(n > 0, c / (n - 1 + alpha), np.nan), np.nan)  # a follower's share after its context
    b = np.append(np.where(rest > 0, (rest - 1 + alpha) / (c + alpha), np.nan), np.nan)  # what a state leaves to its suffix
    c = np.append(c, 0)
    texts, out = texts.combine_chunks(), []
    for p in pieces(texts.column("text"), SPACED, STEP):
        g, k = runs(p)
        at = [index.get(x) for x in g]
        A, B = folded(g, k, [a[x] for x in at], [b[x] for x in at])
        count = np.where(g[0] == ENDED, m.texts, c[at[0]])
        text = np.repeat(np.arange(p.rows), np.diff(p.begin) + 1)
        sums = [np.bincount(text, v, p.rows) for v in (count > 0, np.log10((count + 1) / (m.n + m.v + 1)), np.log10(A + B * m.root(count)))]
        out.append(pa.Table.from_arrays(
            [*(texts.column(x).slice(p.row, p.rows) for x in ("doc_id", "held_out")), pa.array((np.diff(p.begin) + 1).astype(np.int64)), pa.array(sums[0].astype(np.int64)), pa.array(np.full(p.rows, m.n)), pa.array(sums[1]), pa.array(sums[2])],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        ))
    return pa.concat_tables(out)


def score(docs: DataFrame, mod: int = 7, held: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    d = docs.select(F.col(id_col).alias("doc_id"), (fold(id_col, mod) == held).alias("held_out"), text_of(text_col).alias("text"))
    table, totals = fit(d.where("NOT held_out"))
    size = d.agg(F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0))).first()[0]
    many = max(1, int(size) // BLOCK)
    blocks = F.pmod(F.xxhash64("doc_id", "text"), F.lit(many).cast("long"))
    d = d.withColumn("block", blocks).repartition("block").sortWithinPartitions("block")  # one shuffle, read for the keys and for the scores
    shared = screen(table.where("n IS NOT NULL OR rest IS NOT NULL"))
    asked = d.select("block", "text").mapInArrow(lambda b: _asked(b, shared, many), "block long, bucket long, keys binary")
    bucket = F.shiftright((F.shiftright("key", 32) + F.lit(1 << 31)) * many, 32)
    table = table.withColumn("bucket", bucket)
    found = asked.groupBy("bucket").cogroup(table.groupBy("bucket")).applyInArrow(_answered, "block long, keys binary, c binary, n binary, rest binary")
    kind = dict(d.dtypes)["doc_id"]
    return d.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(lambda texts, found: _score(totals, texts, found), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op7_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read_table(spark, sf_dir, "documents"))
