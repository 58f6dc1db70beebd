"""Periodic runs of words by Lyndon roots from Baier's suffix grouping.

A run is a maximal stretch of words with a smallest period. By the runs theorem (Bannai et al. 2017) each has, under the
order of the words or the inverse one, a Lyndon root that is the longest Lyndon word where it starts. The first phase of
Baier's suffix sorter (Baier 2016) groups suffixes by just these words: groups are taken from the largest down, and a group
lengthens the words of the suffixes before its own that are smaller. So both Lyndon arrays come from the grouping, without
a suffix array. Each root is then extended to both sides as long as words a period apart agree (LCE, by comparisons of
doubling length); a stretch is extended once for a period.

Only runs of at least ``TIMES`` periods and ``LEAST`` words are reported. A word in such a run is in it ``TIMES`` times,
so a text is first cut at its words that are rarer, and each part again at those rare in it: no run crosses a cut, and
the grouping has the parts that are left, of any number and length.

Edge cases: null counts as empty, without words; a text of any length is handled whole in its task, in time about
linear in its words; runs of equal length are told apart by start, then period; rows that repeat a doc_id are each
searched, a null doc_id counts as empty text where it decides; an empty table gives no rows; other columns are ignored."""

from __future__ import annotations

from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import read_table, text_of
from .words import buffers

TIMES, LEAST = 4, 6
STEP = 4 << 20  # bytes of text whose results are sent together; a longer text is sent alone
CUTS = 12  # rounds of cutting at most; the grouping needs none


def lyndon(ranks: Sequence[int]) -> list[int]:
    """The length of the longest Lyndon word at each place, by grouping suffixes as in the first phase of Baier's sorter."""
    n = len(ranks)
    values = sorted(set(ranks))
    group = {v: g for g, v in enumerate(values)}
    of = [group[v] for v in ranks]  # each suffix's group: those that begin with the same Lyndon word so far
    members: list[list[int]] = [[] for _ in values]
    for i, g in enumerate(of):
        members[g].append(i)
    size, done = [1] * len(values), [False] * len(values)
    below, above = list(range(-1, len(values) - 1)), list(range(1, len(values) + 1))  # the order of the groups
    before, length = [-1] * n, [0] * n  # the next suffix to the left that is smaller
    g = len(values) - 1
    while g >= 0:
        times: dict[int, int] = defaultdict(int)
        for i in members[g]:
            if of[i] != g:
                continue  # a larger group has it
            length[i] = size[g]
            p = i - 1
            while p >= 0 and done[of[p]]:
                p = before[p]
            if p >= 0 and of[p] == g:
                p = before[p]
            before[i] = p
            if p >= 0:
                times[p] += 1
        done[g] = True
        # Smaller suffixes whose words end where these begin take them in, those with more of them in a larger group.
        parts: dict[tuple[int, int], list[int]] = defaultdict(list)
        for p, k in times.items():
            parts[k, of[p]].append(p)
        for k, h in sorted(parts, reverse=True):
            new, up = len(size), above[h]
            size.append(size[h] + k * size[g])
            members.append(sorted(parts[k, h]))
            done.append(False)
            below.append(h)
            above.append(up)
            above[h] = below[up] = new  # a group that is split is below the one that splits it
            for p in parts[k, h]:
                of[p] = new
        g = below[g]
    return length


def _agree(w: bytes, i: int, j: int, room: int, back: bool) -> int:
    """How many words agree from ``i`` and ``j`` on, or before them, of ``room`` at most; 4 bytes a word."""
    k, step, grow = 0, 4, True
    while room > k:
        s = min(step, room - k)
        a, b = (i - k - s, j - k - s) if back else (i + k, j + k)
        if w[4 * a : 4 * (a + s)] == w[4 * b : 4 * (b + s)]:
            k += s
            step = 2 * s if grow else s
        elif s == 1:
            break
        else:
            step, grow = s // 2, False
    return k


def runs_of(ranks: Sequence[int], times: int = TIMES, least: int = LEAST) -> set[tuple[int, int, int]]:
    """(start, length, period) of the runs of a sequence of words, by their Lyndon roots under both orders."""
    n, w, found = len(ranks), array("I", ranks).tobytes(), set()
    for order in (ranks, [-r for r in ranks]):
        reach: dict[int, int] = {}  # by period, where the last stretch that was extended ends
        for i, p in enumerate(lyndon(order)):
            if times * p > n or reach.get(p, 0) >= i + p:
                continue
            stop = i + p + _agree(w, i, i + p, n - i - p, False)
            start = i - _agree(w, i, i + p, i, True)
            reach[p] = stop
            if stop - start >= max(least, times * p):
                found.add((start, stop - start, p))
    return found


def find(words: list[bytes], times: int = TIMES, least: int = LEAST) -> list[tuple[int, int, int]]:
    """The runs of a text's words by start, then period."""
    found: set[tuple[int, int, int]] = set()
    open_ = [(0, len(words), 0)]
    while open_:
        low, high, cuts = open_.pop()
        if high - low < least:
            continue
        part = words[low:high]
        count = Counter(part)
        if cuts == CUTS or min(count.values()) >= times:
            rank = {x: k for k, x in enumerate(count)}
            found.update((low + s, n, p) for s, n, p in runs_of([rank[x] for x in part], times, least))
            continue
        for common, some in groupby(part, lambda x: count[x] >= times):
            n = sum(1 for _ in some)
            if common:
                open_.append((low, low + n, cuts + 1))
            low += n
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that are in no run after its first period."""
    out, at = [], 0  # all before ``at`` is decided
    for a, b in sorted((s + p, s + n) for s, n, p in runs):
        out += words[at:a]
        at = max(at, b)
    return out + words[at:]


RUN = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))


def _searched(batches: Iterator[pa.RecordBatch], times: int, least: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (doc_id, n_words, runs, collapsed)."""
    for batch in batches:
        data, off = buffers(batch.column(1))
        row = 0
        while row < batch.num_rows:
            last = max(row + 1, int(np.searchsorted(off, off[row] + STEP, "right")) - 1)
            n, runs, texts = [], [], []
            for i in range(row, last):
                words = data[off[i] : off[i + 1]].tobytes().split()  # at 0x20 and 0x09 to 0x0D
                found = find(words, times, least)
                n.append(len(words))
                runs.append([dict(zip(("start", "length", "period"), r)) for r in found])
                texts.append(b" ".join(collapsed(words, found)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, last - row), pa.array(n, pa.int64()), pa.array(runs, RUN), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])
            row = last


def periodic_runs(docs: DataFrame, times: int = TIMES, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row: its runs of ``times`` periods and ``least`` words at least, by
    start, then period, and its words without those that repeat a run's first period, joined by one space."""
    d = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    kind = dict(d.dtypes)["doc_id"]
    return d.mapInArrow(lambda b: _searched(b, times, least), f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def looped(doc_id: Column, text: Column) -> Column:
    """``text``, or for an id in ten its words with the later ones replaced by repeats of a few before them."""
    h = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def repeat(w: Column) -> Column:
        n = F.size(w)
        a = g % n
        p = F.floor((n - a) / (g % 8 + 3)) + 1
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")

    changed = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeat(w)).otherwise(F.lit("")))[0]
    return F.when(h % 10 == 0, changed).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", text_of().alias("text"))
    found = periodic_runs(docs.withColumn("text", looped(F.col("doc_id"), F.col("text"))))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    found = found.withColumn("_l", longest)
    n, start, period = F.col("_l.n"), -F.col("_l.s"), -F.col("_l.p")
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), n.alias("length"), period.alias("period"), F.floor(n * 1000 / period).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
