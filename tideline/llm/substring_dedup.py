"""Substring duplicates: fuzzy passages that documents share, by collinear chaining of k-mer seeds.

Seeds are the minimisers of a text's 6-word hashes, the smallest of every 12 in a row, so every shared run of 17 words has
one. Occurrences of a seed after which the same 40 words follow are a class: its first one, in a batch and then in the
corpus, is matched to all others of the class and stands for them. In the order of what follows, which brings together
those that share more than this seed, the firsts are matched to the seed's first occurrence and to the one before. Where two
seeds in a row that several firsts share don't lie within a passage that was found so, each such occurrence meets all other
firsts of the two seeds, in blocks of bounded size, two at a time. Where a block meets, the words around are compared, and
only pairs go on to chaining that a passage can come of: those whose extension from the two seeds gives enough words, or that
also share another two seeds near by with other words up to them, so that a chain may bridge these. So whatever two texts share in two seeds in a row, as in
any 29 words in a row, is compared, directly or through passages that cover it, however common the seeds are. Of a text, the first occurrence
of each seed and next seed takes part in this; one that it has again is matched to its occurrence before, if that is a
passage's length away, so repeats within one document are found as well, on few diagonals.

The matches of two documents are chained in order, with a cost for each skipped word, through a Fenwick tree over
positions in the other document (Abouelhoda and Ohlebusch 2005). The words of each chain are then aligned: gaps between
seeds by edit distance, the chain being cut into local pieces at gaps that don't agree, so that two passages with other
words between them stay two; the ends of each piece by extension until mismatches prevail; where the words at hand end
first, more are fetched. Passages of enough words and similarity are returned.

Rows with the same id and text are one document, and each of them gets its result. Edge cases: null, empty and short
texts have no passages; texts of any length are read whole; of equally good chains the one that begins first is followed
first; a null doc_id takes part; an empty table gives no rows;
other columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bitmap import bitmap, screened
from .shared import read_table, text_of, written
from .words import SPACED, Piece, grams, lists, mix, pieces, signed, span_hash

K, W = 6, 12
LEAST, ALIKE = 40, 0.8  # words and similarity of a passage
SKIP = 0.1  # cost of a skipped word, where a seed gains K
BRIDGE = LEAST // 2  # words that don't agree and yet may lie within a passage
GAP = 128  # words between seeds that are compared; longer ones that differ end a passage
REACH = 64  # words beyond a chain that are fetched at first; more where the extension needs them
MANY = 4096  # occurrences of two seeds in a row in a block
NEAR = 192  # words in which a passage that goes on after fewer than LEAST words has its next seed, at most GAP on
SLICED = 1 << 20  # words in a batch
TILE = 1 << 18  # pairs of occurrences that are compared at a time


def seeds(p: Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, seed, position) of the minimisers of a piece's texts, in order."""
    g, ok = grams(p, K)
    _, whole = grams(p, K + W - 1)
    n = len(g) - W + 1
    doc = p.doc()
    if n > 0:
        low, at = g[:n].copy(), np.zeros(n, np.int64)
        for i in range(1, W):
            less = g[i : i + n] < low
            low[less] = g[i : i + n][less]
            at[less] = i
        at = np.unique((np.arange(n) + at)[whole[:n]])
    else:
        at = np.zeros(0, np.int64)
    return doc[at], g[at], at - p.begin[doc[at]]


_MATCH = "row long, pos int, anchor long, apos int, gap int"
_NAMES = ["row", "pos", "anchor", "apos", "gap"]
_PLACE = ["pos", "key", "after", "covered", "block", "last"]


def _matches(a: np.ndarray, b: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Pairs of (key, after, far, row, pos) to (row, pos, anchor, apos, gap), the gap being that to a next seed which both
    have, or 0; within a document only at a distance."""
    gap = np.where(a[:, 1] == b[:, 1], a[:, 1] & 15, 0)
    x, y = a[:, 3:], b[:, 3:]
    swap = ((x[:, 0] < y[:, 0]) | ((x[:, 0] == y[:, 0]) & (x[:, 1] < y[:, 1])))[:, None]
    x, y = np.where(swap, y, x), np.where(swap, x, y)
    ok = (x[:, 0] != y[:, 0]) | (x[:, 1] - y[:, 1] >= least)
    return np.concatenate([x, y, gap[:, None]], 1)[ok]


def _leads(rows: np.ndarray) -> np.ndarray:
    """Of rows in order, the place of the first one of each row's (key, after, far)."""
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :3] != rows[:-1, :3]).any(1)
    return np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))


def _anchor(rows: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, after, far, row, pos) rows in this order to matches: each class's first one to its key's first one and to the
    class before, other rows to their class's first. ``held`` has the key's first and the class's first that the rows before
    ended with. Also returns the classes' firsts whose key and next seed may be shared by others, and what to hold."""
    front = 2 if len(held) and len(rows) and held[0, 0] == rows[0, 0] else 0
    all_ = np.concatenate([held[:front], rows])
    if not len(rows):
        return np.zeros((0, 5), np.int64), rows, held
    lead, at = _leads(all_), np.arange(len(all_))
    new_key = np.ones(len(all_), bool)
    new_key[1:] = all_[1:, 0] != all_[:-1, 0]
    first = np.maximum.accumulate(np.where(new_key, at, 0))
    new = (lead == at) & (at >= front)
    later, other = np.flatnonzero(new & ~new_key), np.flatnonzero(~new & (at >= front))
    x, y = np.concatenate([later, later, other]), np.concatenate([first[later], lead[later - 1], lead[other]])
    begin = np.flatnonzero(new_key | np.append(True, all_[1:, 1] != all_[:-1, 1]))
    size = np.diff(np.append(begin, len(all_)))
    several = size > 2  # of two, each met the other
    several[:2] = several[-1:] = True  # may have begun or go on in other rows
    shared = np.repeat(several, size) & new & (all_[:, 1] != 0)
    return np.unique(_matches(all_[x], all_[y]), axis=0), all_[shared], all_[[first[-1], lead[-1]]]


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, row, text) to (doc_id, row, n_words, key, after, far, pos, lpos, anchor, apos, lgap): one occurrence of each
    class in a batch, and the matches of the others. ``after`` has 28 bits of the next seed and the distance to it."""
    for batch in batches:
        n, rows, keys, nexts, fars, pos = [], [], [], [], [], []
        for p in pieces(batch.column(2), SPACED):
            r, k, x = seeds(p)
            n.append(np.diff(p.begin))
            rows.append(r + p.row)
            keys.append(signed(k))
            after = np.zeros(len(k), np.uint32)
            same = np.flatnonzero(r[1:] == r[:-1])
            after[same] = ((k[same + 1] >> np.uint64(36)) << np.uint64(4)).astype(np.uint32) | (x[same + 1] - x[same]).astype(np.uint32)
            nexts.append(after.view(np.int32))
            at = p.begin[r] + x
            fars.append(signed(span_hash(p, at, np.minimum(at + LEAST, p.begin[r + 1]))))
            pos.append(x)
        at, key, after, far, x, n = (np.concatenate([np.zeros(0, np.int64), *v]).astype(np.int64) for v in (rows, keys, nexts, fars, pos, n))
        ids = batch.column(1).to_numpy()
        order = np.lexsort((x, key, at))
        again = (at[order[1:]] == at[order[:-1]]) & (key[order[1:]] == key[order[:-1]])
        late, early = order[1:][again], order[:-1][again]
        distant = x[late] - x[early] >= LEAST
        own = np.stack([ids[at[late]], x[late], ids[at[late]], x[early], np.zeros(len(late), np.int64)], 1)[distant]
        once = np.ones(len(at), bool)
        if len(late):  # the same next seed again
            some = np.unique(np.concatenate([late, early]))
            some = some[np.lexsort((x[some], after[some], key[some], at[some]))]
            once[some[1:]] = (at[some[1:]] != at[some[:-1]]) | (key[some[1:]] != key[some[:-1]]) | (after[some[1:]] != after[some[:-1]])
        once = np.flatnonzero(once)
        whose = ids[at] if len(at) else at
        order = once[np.lexsort((x[once], whose[once], far[once], after[once], key[once]))]
        rows = np.stack([key[order], after[order], far[order], whose[order], x[order]], 1)
        first = _leads(rows)
        new = first == np.arange(len(rows))
        found = np.concatenate([_matches(rows[~new], rows[first[~new]]), own])
        lead = np.sort(order[new])  # in the order of texts
        begin = np.searchsorted(at[lead], np.arange(batch.num_rows + 1))
        place = {r: i for i, r in reversed(list(enumerate(ids)))}
        where = np.array([place[r] for r in found[:, 0]], np.int64)
        by = np.argsort(where, kind="stable")
        local = np.searchsorted(where[by], np.arange(batch.num_rows + 1))
        b, c, d, gap = (np.ascontiguousarray(found[by, i]) for i in range(1, 5))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(n), lists(key[lead], begin), lists(after[lead].astype(np.int32), begin), lists(far[lead], begin), lists(x[lead].astype(np.int32), begin), lists(b.astype(np.int32), local), lists(c, local), lists(d.astype(np.int32), local), lists(gap.astype(np.int32), local)],
            names=["doc_id", "row", "n_words", "key", "after", "far", "pos", "lpos", "anchor", "apos", "lgap"],
        )


def _runs(batches: Iterator[pa.RecordBatch], columns: int, by: int) -> Iterator[list[np.ndarray]]:
    """Batches sorted by their first ``by`` columns, cut anew so that no run of equal ones is divided; only the rows of the
    run that a batch ends with are held back."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [batch.column(i).to_numpy() for i in range(columns)]
        now = now if held is None else [np.concatenate(x) for x in zip(held, now)]
        last = np.ones(len(now[0]), bool)
        for c in now[:by]:
            last &= c == c[-1]
        cut = len(last) - int(last.sum())
        held = [c[cut:] for c in now]
        if cut:
            yield [c[:cut] for c in now]
    if held is not None:
        yield held


def _columns(found: np.ndarray) -> list[pa.Array]:
    return [pa.array(np.ascontiguousarray(found[:, i]).astype(kind)) for i, kind in enumerate((np.int64, np.int32, np.int64, np.int32, np.int32))]


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, after, far, row, pos), in this order, to matches; and, with a key, to the firsts of classes whose two seeds in a
    row others may share."""
    names = [*_NAMES, "key", "after"]
    held = np.zeros((0, 5), np.int64)
    for batch in batches:
        found, shared, held = _anchor(np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(5)], 1), held)
        yield pa.RecordBatch.from_arrays([*_columns(found), pa.nulls(len(found), pa.int64()), pa.nulls(len(found), pa.int32())], names=names)
        key, after, _, row, pos = (np.ascontiguousarray(shared[:, i]) for i in range(5))
        none = [pa.nulls(len(key), kind) for kind in (pa.int64(), pa.int32(), pa.int32())]
        yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(pos.astype(np.int32)), *none, pa.array(key), pa.array(after.astype(np.int32))], names=names)


def _contexts(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """(row, text, places), the places being pairs of seeds in order, to one row a place: ``least`` words before and after it,
    from the nearest on (0 where there is none); and the pairs of seeds within NEAR words, with the words up to their ends."""
    for batch in batches:
        at = batch.column(2)
        first, place = at.offsets.to_numpy().astype(np.int64), {f.name: at.values.field(i) for i, f in enumerate(at.type.value_type)}
        key, after, pos = (place[c].to_numpy().astype(np.int64) for c in ("key", "after", "pos"))
        stop = pos + (after & 15) + K
        name = mix(key.view(np.uint64) ^ mix(after.view(np.uint64)))
        for p in pieces(batch.column(1), SPACED):
            some = np.arange(first[p.row], first[p.row + p.rows])
            doc = np.repeat(np.arange(p.rows), np.diff(first[p.row : p.row + p.rows + 1]))
            words = np.append(np.maximum((p.hashes >> np.uint64(32)).astype(np.uint32), 1), 0).astype(np.uint32).view(np.int32)
            lo, hi = p.begin[doc][:, None], p.begin[doc + 1][:, None]
            left, right = lo + pos[some, None] - 1 - np.arange(least), lo + stop[some, None] + np.arange(least)
            left, right = words[np.where(left >= lo, left, -1)], words[np.where(right < hi, right, -1)]
            # Places are in order within a row: the next one, the one after it, and so on while any is near.
            one, two, step = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 1
            while step < len(some):
                near = np.flatnonzero((doc[step:] == doc[:-step]) & (pos[some[step:]] - pos[some[:-step]] <= NEAR))
                if not len(near):
                    break
                one.append(near)
                two.append(near + step)
                step += 1
            one, two = np.concatenate(one), np.concatenate(two)
            between = span_hash(p, p.begin[doc[one]] + pos[some[one]], p.begin[doc[one]] + np.maximum(stop[some[one]], stop[some[two]])) if len(one) else np.zeros(0, np.uint64)
            whose, other = np.concatenate([one, two]), np.concatenate([mix(name[some[two]]), name[some[one]]])  # which side it is on counts
            by = np.argsort(whose, kind="stable")
            begin = np.searchsorted(whose[by], np.arange(len(some) + 1))
            wide = np.arange(len(some) + 1) * least
            rows = batch.column(0).slice(p.row, p.rows).take(pa.array(doc))
            yield pa.RecordBatch.from_arrays(
                [*(place[c].slice(first[p.row], len(some)) for c in _PLACE), rows, lists(left.ravel(), wide), lists(right.ravel(), wide), lists(signed(other[by]), begin), lists(signed(np.concatenate([between, between])[by]), begin)],
                names=[*_PLACE, "row", "left", "right", "near", "between"],
            )


def _reaches(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of all pairs of rows of words, how far ``_extend`` comes, and whether it hasn't ended where the words do."""
    shape = len(a), len(b)
    total, top, far, on = np.zeros(shape, np.int16), np.zeros(shape, np.int16), np.zeros(shape, np.int16), np.ones(shape, bool)
    for i in range(a.shape[1]):
        same = a[:, None, i] == b[None, :, i]
        same &= (a[:, i] != 0)[:, None]
        total += same * np.int16(3)
        total -= np.int16(2)
        on &= top - total < 8
        if not on.any():
            break
        np.copyto(far, np.int16(i + 1), where=on & (total > top))
        np.maximum(top, total, out=top)
    return far, on


def _promising(block: pa.Table, a: np.ndarray, b: np.ndarray, least: int) -> np.ndarray:
    """Of all pairs of two lists of rows of a block, which may belong to a passage of ``least`` words: the words on both
    sides agree so far, or both rows have another pair of seeds near, with other words up to it."""
    left, right = (block.column(c).combine_chunks().values.to_numpy().reshape(block.num_rows, -1) for c in ("left", "right"))
    near, between = (block.column(c).combine_chunks() for c in ("near", "between"))
    off, near, between = near.offsets.to_numpy(), near.values.to_numpy(), between.values.to_numpy()
    need = least - (block.column("after")[0].as_py() & 15) - K
    out = np.zeros((len(a), len(b)), bool)
    step = max(1, TILE // max(len(b), 1))
    for i in range(0, len(a), step):
        (l, m), (r, n) = _reaches(left[a[i : i + step]], left[b]), _reaches(right[a[i : i + step]], right[b])
        out[i : i + step] = m | n | (l + r >= need)

    def entries(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = off[rows + 1] - off[rows]
        place = np.repeat(off[rows] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        by = np.argsort(near[place], kind="stable")
        return np.repeat(np.arange(len(rows)), size)[by], near[place][by], between[place][by]

    (i, u, x), (j, v, y) = entries(a), entries(b)
    for name in np.intersect1d(u, v):
        p, q = (slice(*(int(np.searchsorted(w, name, side)) for side in ("left", "right"))) for w in (u, v))
        differ = x[p][:, None] != y[q][None, :]
        if differ.any():
            out[np.ix_(i[p], j[q])] |= differ
    return out


def _cross(block: pa.Table, least: int = LEAST) -> pa.Table:
    """Matches between two blocks of a pair of seeds, or within one, of which one isn't covered; with contexts, those that
    are promising."""
    key, after, number, row, pos = (block.column(c).to_numpy().astype(np.int64) for c in ("key", "after", "block", "row", "pos"))
    bare = ~block.column("covered").to_numpy(zero_copy_only=False)
    rows = np.stack([key, after, np.zeros(len(key), np.int64), row, pos], 1)
    once = np.unique(np.stack([number, row, pos], 1), axis=0, return_index=True)[1]  # rows that repeat are there again
    a, b = once[number[once] == number.min()], once[number[once] == number.max()]
    same, out = number.min() == number.max(), [_matches(rows[:0], rows[:0])]
    for a, b in ((a[bare[a]], b), (a[~bare[a]], b[bare[b]])) if not same else ((a[bare[a]], b),):
        step = max(1, (TILE * 16) // max(len(b), 1))
        for i in range(0, len(a), step):
            part = a[i : i + step]
            ok = _promising(block, part, b, least) if "left" in block.column_names else np.ones((len(part), len(b)), bool)
            if same:
                ok &= ~bare[b][None, :] | (part[:, None] < b[None, :])
            x, y = np.nonzero(ok)
            out.append(_matches(rows[part[x]], rows[b[y]]))
    return pa.Table.from_arrays(_columns(np.concatenate(out)), names=_NAMES)


def crossed(shared: DataFrame, spans: DataFrame, many: int = MANY, docs: DataFrame | None = None, least: int = LEAST) -> DataFrame:
    """Matches of ``shared`` (key, after, row, pos), all pairs of one key and after of which one isn't covered by a span
    (row, start, stop): in blocks of ``many``, two at a time. With ``docs`` (row, text), of these pairs those that may belong
    to a passage of ``least`` words."""
    stop = F.col("pos") + F.col("after").bitwiseAND(15) + K
    none = lambda *kinds: [F.lit(None).cast(k).alias(n) for n, k in kinds]
    both = shared.select("row", F.col("pos").alias("at"), F.lit(1).alias("kind"), stop.alias("stop"), "key", "after")
    both = both.unionByName(spans.select("row", F.col("start").alias("at"), F.lit(0).alias("kind"), "stop", *none(("key", "long"), ("after", "int"))))
    reach = F.max(F.when(F.col("kind") == 0, F.col("stop"))).over(Window.partitionBy("row").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0))
    of = both.withColumn("covered", F.coalesce(reach >= F.col("stop"), F.lit(False))).where("kind = 1").select("key", "after", "row", F.col("at").alias("pos"), "covered")
    of = written(of, "shared")
    groups = of.groupBy("key", "after").agg(F.count("*").alias("n"), F.count_if(~F.col("covered")).alias("bare")).where("n > 2 AND bare > 0").select("key", "after", F.floor((F.col("n") - 1) / many).cast("int").alias("last"))
    number = F.floor((F.row_number().over(Window.partitionBy("key", "after").orderBy("row", "pos")) - 1) / many).cast("int")
    of = of.join(groups.hint("merge"), ["key", "after"]).withColumn("block", number)
    context = []
    if docs is not None:
        of = written(of, "occurrences")
        places = of.groupBy("row").agg(F.sort_array(F.collect_list(F.struct(*_PLACE))).alias("places"))
        texts = screened(docs.select("row", "text"), F.xxhash64("row"), bitmap(places.select("row"), "row"))
        context = ["left", "right", "near", "between"]
        of = texts.join(places.hint("merge"), "row").select("row", "text", "places").mapInArrow(lambda b: _contexts(b, least), "pos int, key long, after int, covered boolean, block int, last int, row long, left array<int>, right array<int>, near array<long>, between array<long>")
    of = of.withColumn("other", F.explode(F.expr("sequence(0, last)"))).select("key", "after", "block", "row", "pos", "covered", *context, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    return of.groupBy("key", "after", "i", "j").applyInArrow(lambda block: _cross(block, least), _MATCH)


def chain(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Collinear chains of matches (x[i], y[i]), each the indices of its matches in order; every match is in one at most.

    f(i) = K + max(0, max over x[j] < x[i], y[j] < y[i] of f(j) - SKIP * words skipped on both sides); with a cost linear
    in x + y, the inner maximum is a prefix maximum of f(j) + SKIP * (x[j] + y[j]) over y, kept in a Fenwick tree."""
    gain, cost = 10 * K, round(10 * SKIP)  # in tenths, so that ties are exact
    order = np.lexsort((-y, x))
    rank = np.unique(y, return_inverse=True)[1] + 1
    size = int(rank.max()) if len(rank) else 0
    best: list[tuple[int, int]] = [(-(1 << 60), -1)] * (size + 1)
    f, back = np.zeros(len(x), np.int64), np.full(len(x), -1)
    for i in order.tolist():
        v, j, r = -(1 << 60), -1, int(rank[i]) - 1
        while r > 0:
            if best[r][0] > v:
                v, j = best[r]
            r -= r & -r
        at = int(x[i] + y[i])
        total = v - cost * at if j >= 0 else 0
        f[i], back[i] = (gain + total, j) if total > 0 else (gain, -1)
        put, r = (int(f[i]) + cost * at, i), int(rank[i])
        while r <= size:
            if put[0] > best[r][0]:
                best[r] = put
            r += r & -r
    used, out = np.zeros(len(x), bool), []
    for i in np.argsort(-f, kind="stable").tolist():
        path = []
        while i >= 0 and not used[i]:
            used[i] = True
            path.append(i)
            i = int(back[i])
        if path:
            out.append(np.array(path[::-1]))
    return out


def one_chain(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether ``chain`` makes one chain of matches on one diagonal: by the recurrence each is best reached from the one
    before, if that pays for the gap, and the last must have the highest score."""
    dx, dy = np.diff(x), np.diff(y)
    if not ((dx > 0).all() and (dx == dy).all()):
        return False
    f = 10 * K * np.arange(1, len(x) + 1) - 2 * round(10 * SKIP) * (x - x[0])
    return bool((f[1:] > 10 * K).all() and (f[:-1] < f[-1]).all())


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches (anchor, row, x, y, gap), sorted by pair of documents, to chains."""
    for anchor, row, x, y, gap in _runs(batches, 5, 2):
        two = gap > 0  # the next seed is matched as well
        anchor, row = (np.concatenate([v, v[two]]) for v in (anchor, row))
        x, y = (np.concatenate([v, (v + gap)[two]]) for v in (x, y))
        order = np.lexsort((y, x, row, anchor))
        row, x, anchor, y = row[order], x[order].astype(np.int64), anchor[order], y[order].astype(np.int64)
        keep = np.ones(len(row), bool)
        keep[1:] = (row[1:] != row[:-1]) | (anchor[1:] != anchor[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        row, x, anchor, y = (v[keep] for v in (row, x, anchor, y))
        cut = np.flatnonzero((row[1:] != row[:-1]) | (anchor[1:] != anchor[:-1])) + 1
        out = []
        for a, b in zip([0, *cut], [*cut, len(row)]):
            for path in [np.arange(b - a)] if b - a > 1 and one_chain(x[a:b], y[a:b]) else chain(x[a:b], y[a:b]):
                if len(path) > 1:
                    out.append((row[a], anchor[a], x[a + path], y[a + path]))
        cuts = np.concatenate([[0], np.cumsum([len(o[2]) for o in out])]).astype(np.int64)
        flat = [np.concatenate([np.zeros(0, np.int64), *[o[i] for o in out]]).astype(np.int32) for i in (2, 3)]
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), lists(flat[0], cuts), lists(flat[1], cuts)], names=["row", "anchor", "xs", "ys"])


def _slice(batches: Iterator[pa.RecordBatch], reach: int) -> Iterator[pa.RecordBatch]:
    """(pid, side, lo, hi, text, row), rows in order, to (pid, side, at, more, words): the words from ``reach`` before lo to
    ``reach`` after hi, and whether the text goes on after them. A text of several rows in a row is split into words once."""
    for batch in batches:
        lo, hi, row = (batch.column(i).to_numpy().astype(np.int64) for i in (2, 3, 5))
        new = np.append(np.ones(min(1, len(row)), bool), row[1:] != row[:-1])
        whose = np.cumsum(new) - 1
        for p in pieces(batch.column(4).take(pa.array(np.flatnonzero(new))), SPACED):
            first, last = np.searchsorted(whose, [p.row, p.row + p.rows])
            of = whose[first:last] - p.row
            size = np.diff(p.begin)[of]
            a, b = np.maximum(lo[first:last] - reach, 0), np.minimum(hi[first:last] + reach, size)
            words = (p.hashes >> np.uint64(32)).astype(np.uint32).view(np.int32)
            begin = np.concatenate([[0], np.cumsum(b - a)])
            i = 0
            while i < len(of):
                j = max(i + 1, int(np.searchsorted(begin, begin[i] + SLICED, "right")) - 1)
                place = np.arange(begin[i], begin[j]) + np.repeat((p.begin[of] + a - begin[:-1])[i:j], np.diff(begin[i : j + 1]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first + i, j - i), batch.column(1).slice(first + i, j - i), pa.array(a[i:j].astype(np.int32)), pa.array((b < size)[i:j]), lists(words[place], begin[i : j + 1] - begin[i])], names=["pid", "side", "at", "more", "words"])
                i = j


def _distance(a: np.ndarray, b: np.ndarray) -> int:
    """Edit distance of two short runs of words, row by row."""
    row = np.arange(len(b) + 1)
    for i, w in enumerate(a):
        step = np.minimum(row[1:] + 1, row[:-1] + (b != w))
        row = np.minimum.accumulate(np.concatenate([[i + 1], step]) - np.arange(len(b) + 1)) + np.arange(len(b) + 1)
    return int(row[-1])


def _extend(a: np.ndarray, b: np.ndarray) -> tuple[int, bool]:
    """How many words of two runs, compared from their beginnings, still agree on the whole (4 mismatches end it), and
    whether they did end within the runs."""
    n = min(len(a), len(b))
    if not n:
        return 0, False
    total = np.cumsum(np.where(a[:n] == b[:n], 1, -2))
    drop = np.flatnonzero(np.maximum.accumulate(np.maximum(total, 0)) - total >= 8)
    total = total[: drop[0]] if len(drop) else total
    return int(np.argmax(total)) + 1 if len(total) and total.max() > 0 else 0, bool(len(drop))


def local_pieces(a: np.ndarray, b: np.ndarray, xs: np.ndarray, ys: np.ndarray, alike: float = ALIKE) -> list[tuple[int, int, int]]:
    """A chain's seeds cut where the words between two of them don't agree: (first seed, seed after the last, edits between).

    A gap is scored as an extension is, 1 for a word that agrees and -2 for an edit; at -8 or less the chain is cut. A cut
    of at most BRIDGE words is taken back if the pieces on both sides, with its edits, are alike as one."""
    n = len(xs)
    edits, wide = np.zeros(n, np.int64), np.zeros(n, np.int64)  # of the gap before each seed
    cut = np.zeros(n, bool)
    differ = np.arange(1, n)
    if (np.diff(xs) == np.diff(ys)).all():  # on one diagonal only gaps with other words matter
        other = np.concatenate([[0], np.cumsum(a[xs[0] : xs[-1]] != b[ys[0] : ys[-1]])])
        start, stop = np.minimum(xs[:-1] + K, xs[1:]) - xs[0], xs[1:] - xs[0]
        differ = differ[other[stop] > other[start]]
    for i in differ.tolist():
        u, v = a[xs[i - 1] + K : xs[i]], b[ys[i - 1] + K : ys[i]]
        dx, dy = int(xs[i] - xs[i - 1]), int(ys[i] - ys[i - 1])
        if min(dx, dy) < K:
            edits[i] = abs(dx - dy)
        elif len(u) != len(v) or (u != v).any():
            wide[i] = max(len(u), len(v))
            edits[i] = _distance(u, v) if wide[i] <= GAP else wide[i]
        cut[i] = wide[i] > GAP or 3 * edits[i] - wide[i] >= 8
    out: list[tuple[int, int, int]] = []
    starts = [0, *np.flatnonzero(cut).tolist()]
    for at, stop in zip(starts, [*starts[1:], n]):
        inner = int(edits[at + 1 : stop].sum())
        while out and wide[at] <= BRIDGE:
            first, _, before = out[-1]
            total = before + int(edits[at]) + inner
            if total > (1 - alike) * max(xs[stop - 1] - xs[first] + K, ys[stop - 1] - ys[first] + K):
                break
            out.pop()
            at, inner = first, total
        out.append((at, stop, inner))
    return out


def align(a: np.ndarray, b: np.ndarray, xs: np.ndarray, ys: np.ndarray, edits: int) -> tuple[int, int, int, int, float, bool, bool]:
    """The passage around a piece of a chain, which has ``edits`` between its seeds, as spans of a and b, its similarity (1
    less edits a word of the longer side), and whether it ended before the words at hand did, on the left and on the right."""
    before, left = _extend(a[: xs[0]][::-1], b[: ys[0]][::-1])
    end = xs[-1] + K, ys[-1] + K
    after, right = _extend(a[end[0] :], b[end[1] :])
    edits += int((a[xs[0] - before : xs[0]] != b[ys[0] - before : ys[0]]).sum()) + int((a[end[0] : end[0] + after] != b[end[1] : end[1] + after]).sum())
    lo, hi = (int(xs[0] - before), int(ys[0] - before)), (int(end[0] + after), int(end[1] + after))
    return lo[0], hi[0], lo[1], hi[1], 1 - edits / max(hi[0] - lo[0], hi[1] - lo[1], 1), left, right


_FOUND = "pid long, row long, start int, stop int, anchor long, astart int, astop int, similarity double, again boolean"


def _align(batches: Iterator[pa.RecordBatch], least: int, alike: float) -> Iterator[pa.RecordBatch]:
    """(pid, row, anchor, xs, ys, sides) to passages; ``again`` where the words at hand ended before the extension did."""
    for batch in batches:
        out = []
        pid, row, anchor = (batch.column(i).to_numpy() for i in range(3))
        flat = [(c.values.to_numpy(), c.offsets.to_numpy()) for c in (batch.column(3), batch.column(4))]
        both, of = batch.column(5).values, batch.column(5).offsets.to_numpy()
        side, where, more = (both.field(c).to_numpy(zero_copy_only=False) for c in ("side", "at", "more"))
        words, at = both.field("words").values.to_numpy(), both.field("words").offsets.to_numpy()
        for i in range(batch.num_rows):
            found = {int(side[j]): j for j in range(of[i], of[i + 1])}
            if len(found) == 2:
                (p, a, m), (q, b, n) = ((int(where[j]), words[at[j] : at[j + 1]], bool(more[j])) for j in (found[0], found[1]))
                xs, ys = (v[o[i] : o[i + 1]].astype(np.int64) - z for (v, o), z in zip(flat, (p, q)))
                for lo, hi, edits in local_pieces(a, b, xs, ys, alike):
                    x, y = xs[lo:hi], ys[lo:hi]
                    s, t, u, v, sim, left, right = align(a, b, x, y, edits)
                    # The side with fewer words stops the extension: it matters if its text goes on.
                    cut_left = not left and (p > 0 if x[0] <= y[0] else q > 0)
                    cut_right = not right and (m if len(a) - x[-1] <= len(b) - y[-1] else n)
                    good = min(t - s, v - u) >= least and sim >= alike
                    if cut_left or cut_right or good:
                        out.append((pid[i], row[i], s + p, t + p, anchor[i], u + q, v + q, sim, bool(cut_left or cut_right)))
        cols = list(zip(*out)) or [()] * 9
        kinds = [pa.int64(), *[pa.int64(), pa.int32(), pa.int32()] * 2, pa.float64(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["pid", "row", "start", "stop", "anchor", "astart", "astop", "similarity", "again"])


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, alike: float = ALIKE, many: int = MANY) -> tuple[DataFrame, DataFrame]:
    """(doc_id, row, n_words) of every row, and (row, start, stop, anchor, astart, astop, similarity): words start to stop
    of document ``row`` are those of document ``anchor`` from astart to astop, but for some edits."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col), text_of(text_col)).alias("row"), text_of(text_col).alias("text"))
    kind = dict(d.dtypes)["doc_id"]
    t = written(d.mapInArrow(_sketch, f"doc_id {kind}, row long, n_words long, key array<long>, after array<int>, far array<long>, pos array<int>, lpos array<int>, anchor array<long>, apos array<int>, lgap array<int>"), "seeds")
    one = t.select("row", "after", "far", "pos", F.posexplode("key").alias("i", "key")).select("key", F.expr("after[i]").alias("after"), F.expr("far[i]").alias("far"), "row", F.expr("pos[i]").alias("pos"))
    met = written(one.repartition("key").sortWithinPartitions("key", "after", "far", "row", "pos").mapInArrow(_meet, f"{_MATCH}, key long, after int"), "matches")
    local = t.select("row", "anchor", "apos", "lgap", F.posexplode("lpos").alias("i", "p")).select("row", F.col("p").alias("pos"), F.expr("anchor[i]").alias("anchor"), F.expr("apos[i]").alias("apos"), F.expr("lgap[i]").alias("gap"))
    found = _found(d, met.where("key IS NULL").select(*_NAMES).unionByName(local), least, alike)
    spans = found.select("row", "start", "stop").unionByName(found.select(F.col("anchor").alias("row"), F.col("astart").alias("start"), F.col("astop").alias("stop")))
    rest = written(crossed(met.where("key IS NOT NULL").select("key", "after", "row", "pos"), spans, many, d, least), "rest")
    if not rest.isEmpty():
        found = found.unionByName(_found(d, rest, least, alike))
    return t.select("doc_id", "row", "n_words"), found


def _found(d: DataFrame, matches: DataFrame, least: int, alike: float) -> DataFrame:
    """Passages of the texts ``d`` from matches."""
    pairs = matches.select("anchor", "row", F.col("pos").alias("x"), F.col("apos").alias("y"), "gap")
    chained = pairs.repartition("anchor", "row").sortWithinPartitions("anchor", "row").mapInArrow(_chains, "row long, anchor long, xs array<int>, ys array<int>")
    chained = written(chained.withColumn("pid", F.monotonically_increasing_id()), "chains")
    found, reach, left = None, REACH, chained
    while True:  # few chains need a second round, and reach grows eightfold
        got = written(_aligned(d, left, reach, least, alike), "passages")
        done = got.where(f"NOT again AND least(stop - start, astop - astart) >= {least} AND similarity >= {alike}").drop("pid", "again")
        found = done if found is None else found.unionByName(done)
        again = got.where("again")
        if again.isEmpty():
            return found
        left, reach = chained.join(again.select("pid").hint("merge"), "pid", "left_semi"), reach * 8


def _aligned(d: DataFrame, chained: DataFrame, reach: int, least: int, alike: float) -> DataFrame:
    ends = lambda c: (F.element_at(c, 1).alias("lo"), (F.element_at(c, -1) + K).alias("hi"))
    want = chained.select("pid", F.lit(0).alias("side"), "row", *ends("xs")).unionByName(chained.select("pid", F.lit(1).alias("side"), F.col("anchor").alias("row"), *ends("ys")))
    texts = screened(d.select("row", "text"), F.xxhash64("row"), bitmap(want.select("row").distinct(), "row"))
    # A merge join at every size; rows that repeat give the same words again.
    sides = texts.join(want.hint("merge"), "row").select("pid", "side", "lo", "hi", "text", "row").mapInArrow(lambda b: _slice(b, reach), "pid long, side int, at int, more boolean, words array<int>")
    both = sides.groupBy("pid").agg(F.collect_set(F.struct("side", "at", "more", "words")).alias("sides"))
    rows = chained.join(both.hint("merge"), "pid").select("pid", "row", "anchor", "xs", "ys", "sides")
    return rows.mapInArrow(lambda b: _align(b, least, alike), _FOUND)


def substring_dedup(docs: DataFrame, **how) -> DataFrame:
    """Per row: doc_id, n_words, n_repeated (words in shared passages), spans, and with_docs, the documents whose
    occurrences stand for the passages (a document that stands for one lists itself)."""
    t, found = passages(docs, **how)
    spans = found.select("row", "start", "stop", "anchor").unionByName(found.select(F.col("anchor").alias("row"), F.col("astart").alias("start"), F.col("astop").alias("stop"), "anchor"))
    whose = t.groupBy("row").agg(F.first("doc_id").alias("with_doc"))
    stands = spans.select("row", "anchor").distinct().join(whose.withColumnRenamed("row", "anchor").hint("merge"), "anchor").groupBy("row").agg(F.sort_array(F.collect_set("with_doc")).alias("with_docs"))
    # For each start the longest: a document has no more spans than words.
    spans = spans.groupBy("row", "start").agg(F.max("stop").alias("stop")).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("s"))
    merged = """aggregate(s, array(struct(-1 AS start, -1 AS stop)), (a, x) ->
      IF(x.start <= element_at(a, -1).stop, concat(slice(a, 1, size(a) - 1), array(struct(element_at(a, -1).start AS start, greatest(element_at(a, -1).stop, x.stop) AS stop))), concat(a, array(x))))"""
    per = spans.select("row", F.expr(f"slice({merged}, 2, 1 << 30)").alias("spans")).join(stands.hint("merge"), "row")
    out = t.join(per.hint("merge"), "row", "left")
    return out.select("doc_id", "n_words", F.coalesce(F.expr("aggregate(spans, 0L, (a, x) -> a + x.stop - x.start)"), F.lit(0)).cast("long").alias("n_repeated"), F.col("spans").isNotNull().alias("repeated"), "spans", "with_docs")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(read_table(spark, sf_dir, "documents"))
