import random

import numpy as np
import pyarrow as pa
import pytest

from tideline.llm import substring_dedup as S


def test_distance_and_extension():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randrange(3) for _ in range(rng.randrange(8))] for _ in range(2))
        d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
        assert S._distance(np.array(a), np.array(b)) == d[-1][-1]
    assert S._extend(np.array([1, 2, 9, 4, 5, 6, 7, 7, 7]), np.array([1, 2, 3, 4, 5, 6, 0, 0, 0])) == (6, False)
    assert S._extend(np.arange(9), np.append(np.arange(3), np.zeros(6, int))) == (3, True)


def test_chain_against_all_pairs():
    rng = random.Random(2)
    for _ in range(100):
        n = rng.randrange(1, 30)
        x, y = (np.array([rng.randrange(60) for _ in range(n)]) for _ in range(2))
        f = {}
        for i in sorted(range(n), key=lambda i: (x[i], -y[i])):
            f[i] = S.K + max([0, *(f[j] - S.SKIP * (x[i] + y[i] - x[j] - y[j]) for j in f if x[j] < x[i] and y[j] < y[i])])
        got = S.chain(x, y)
        assert sorted(i for c in got for i in c) == list(range(n))
        best = got[0]
        assert (np.diff(x[best]) > 0).all() and (np.diff(y[best]) > 0).all()
        score = S.K * len(best) - S.SKIP * (x[best[-1]] + y[best[-1]] - x[best[0]] - y[best[0]])
        assert abs(score - max(f.values())) < 1e-9


def test_planted_passages(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    text = lambda n: [word() for _ in range(n)]
    exact, fuzzy, short = text(60), text(80), text(20)
    rows, want = [(0, None), (1, ""), (2, "few words")], set()
    for i in range(10, 90):
        w = text(rng.choice([30, 100, 300]))
        at = rng.randrange(len(w))
        if i % 4 == 0:
            w[at:at] = exact
            want.add(i)
        elif i % 4 == 1:
            p = list(fuzzy)
            for _ in range(3):
                p[rng.randrange(80)] = word()
            del p[rng.randrange(70)]
            w[at:at] = p
            want.add(i)
        elif i % 4 == 2:
            w[at:at] = short
        rows.append((i, " ".join(w)))
    rows += [(None, " ".join(text(10) + exact)), (12, rows[5][1]), (500, "again and " * 8000)]
    got = S.substring_dedup(spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, row int")).collect()
    assert len(got) == len(rows)
    found = {r.doc_id for r in got if r.repeated}
    assert found == want | {None, *([12] if rows[5][0] in want else [])}
    for r in got:
        if r.doc_id is not None and r.repeated and r.doc_id % 4 == 0:
            assert 60 <= r.n_repeated <= 70 and len(r.spans) == 1 and r.with_docs
        if not r.repeated:
            assert r.n_repeated == 0 and r.spans is None
    assert S.substring_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_one_chain_is_what_the_recurrence_gives():
    rng = random.Random(4)
    seen = set()
    for _ in range(300):
        x = np.cumsum([rng.choice([1, 5, 12, 29, 31, 60]) for _ in range(rng.randrange(2, 9))])
        whole = S.one_chain(x, x + 7)
        got = S.chain(x, x + 7)
        assert whole == (len(got) == 1 and got[0].tolist() == list(range(len(x))))
        seen.add(whole)
    assert seen == {True, False}


def test_repeats_within_one_document(spark):
    rng = random.Random(5)
    text = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage = text(80)
    rows = [(1, " ".join(text(50) + passage + text(60) + passage + text(10))), (2, " ".join(text(200)))]
    got = {r.doc_id: r for r in S.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert 155 <= got[1].n_repeated <= 165 and got[1].with_docs == [1] and not got[2].repeated


def test_long_passages_are_extended_to_their_ends(spark, monkeypatch):
    monkeypatch.setattr(S, "REACH", 4)
    rng = random.Random(6)
    text = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage = text(300)
    rows = [(i, " ".join(text(40) + passage + text(40))) for i in range(2)]
    got = S.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(300 <= r.n_repeated <= 304 for r in got)


def test_recall_against_planted_pairs_at_any_batch_size(spark):
    """Two documents share a passage of 100 words, edited in one; each of its sentences also stands in another document."""
    rng = random.Random(7)
    text = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows, pairs = [], {0.0: [], 0.05: [], 0.1: []}
    for k in range(60):
        share = list(pairs)[k % 3]
        passage = text(100)
        edited = [w if rng.random() >= share else "edit" for w in passage]
        a, b = 1000 + 2 * k, 1001 + 2 * k
        pairs[share].append((a, b))
        rows += [(a, " ".join(text(60) + passage + text(60))), (b, " ".join(text(30) + edited + text(90)))]
        rows += [(10 * k + j, " ".join(text(20) + passage[lo : lo + 34] + text(20))) for j, lo in enumerate((0, 33, 66))]
    rng.shuffle(rows)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("1", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            found = {r.doc_id for r in S.substring_dedup(d.repartition(3)).where("repeated").collect()}
            for share, least in ((0.0, 1.0), (0.05, 0.9), (0.1, 0.5)):
                assert sum(a in found and b in found for a, b in pairs[share]) >= least * len(pairs[share]), share
            assert all(i >= 1000 for i in found)  # sentences of 34 words are no passages
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_two_passages_in_a_pair_stay_two(spark):
    """Every pair of documents against its planted spans: long and short passages with unrelated words between them."""
    rng = random.Random(8)
    text = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows, want = [], {}
    cases = [((300, 300), 200), ((300, 300), 150), ((50, 60), 40), ((60, 400), 25), ((45, 30), 60), ((300, 45, 300), 90), ((30, 30), 8), ((1000, 1000), 700)]
    for k, (sizes, gap) in enumerate(cases):
        parts = [text(n) for n in sizes]
        for side in (0, 1):
            words, spans = text(30 + 20 * side), []
            for part in parts:
                spans.append((len(words), len(words) + len(part)))
                words += part + text(gap)
            rows.append((2 * k + side, " ".join(words)))
            want[2 * k + side] = [(spans[0][0], spans[1][1])] if gap == 8 else [x for x in spans if x[1] - x[0] >= 40]
    got = {r.doc_id: [tuple(x) for x in r.spans or []] for r in S.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, spans in want.items():
        assert len(got[i]) == len(spans), (i, got[i], spans)
        assert all(abs(a - c) <= 3 and abs(b - d) <= 3 for (a, b), (c, d) in zip(got[i], spans)), (i, got[i], spans)


def test_pieces_of_a_chain():
    a = np.arange(1000)
    b = np.concatenate([np.arange(100), 5000 + np.arange(50), np.arange(150, 400), 7000 + np.arange(5), np.arange(405, 1000)])
    seeds = np.array([10, 40, 90, 160, 200, 390, 410, 900])
    got = S.local_pieces(a, b, seeds, seeds)
    assert [(lo, hi) for lo, hi, _ in got] == [(0, 3), (3, 8)] and got[1][2] == 5


def test_common_seeds_meet_all_that_share_the_next_one(spark):
    rng = random.Random(10)
    rows = sorted({(rng.choice([1, 2, 2, 2, *range(3, 40)]), rng.choice([0, 17, 35, 50]), rng.randrange(12), rng.randrange(10**6), rng.randrange(9)) for _ in range(400)})
    classes, pairs = {}, {}
    for r in rows:
        classes.setdefault(r[:3], r)
        pairs.setdefault(r[:2], set())
    for r in classes.values():
        pairs[r[:2]].add(r[3:])
    star = {frozenset((r[3:], classes[r[:3]][3:])) for r in rows if classes[r[:3]] != r}
    for size in (1, 7, 400):
        cols = lambda part: pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], k) for i, k in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32()))], names=list("abcde"))
        out = [r for b in S._meet(iter([cols(rows[i : i + size]) for i in range(0, len(rows), size)])) for r in b.to_pylist()]
        assert star <= {frozenset(((r["row"], r["pos"]), (r["anchor"], r["apos"]))) for r in out if r["key"] is None}
        shared = [(r["key"], r["after"], r["row"], r["pos"]) for r in out if r["key"] is not None]
        assert len(set(shared)) == len(shared)
        assert {x for x in shared if len(pairs[x[:2]]) > 2} == {(*k, *x) for k, firsts in pairs.items() if k[1] and len(firsts) > 2 for x in firsts}
    bare = {x for x in shared if x[2] % 3 == 0}
    spans = [(x[2], x[3], x[3] + (x[1] & 15) + S.K) for x in shared if x not in bare] + [(x[2], x[3] + 1, x[3] + 90) for x in bare]
    want = {frozenset((a[2:], b[2:])) for a in shared for b in shared if a > b and a[:2] == b[:2] and (a in bare or b in bare) and len(pairs[a[:2]]) > 2}
    got = S.crossed(spark.createDataFrame(shared, "key long, after int, row long, pos int"), spark.createDataFrame(spans, "row long, start int, stop int"), 3).collect()
    assert {frozenset(((r.row, r.pos), (r.anchor, r.apos))) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("how", [{}, {"many": 3}])
def test_passages_of_common_sentences_are_found(spark, how):
    """Pairs of documents share two sentences in a row; each sentence is too short for a passage and stands in 40 others."""
    rng = random.Random(11)
    text = lambda n: [f"w{rng.randrange(10**7)}" for _ in range(n)]
    sentences = [text(34) for _ in range(12)]
    rows = [(1000 * k + i, " ".join(text(20) + s + text(20))) for k, s in enumerate(sentences) for i in range(40)]
    for k in range(12):
        both = sentences[k] + sentences[(5 * k + 3) % 12] if (5 * k + 3) % 12 != k else sentences[k] + sentences[(k + 1) % 12]
        rows += [(10**6 + 2 * k + side, " ".join(text(25 + side) + both + text(30))) for side in (0, 1)]
    rng.shuffle(rows)
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.n_repeated for r in S.substring_dedup(d, **how).where("repeated").collect()}
    assert set(got) == {10**6 + i for i in range(24)}
    assert all(68 <= n <= 74 for n in got.values())


def test_reaches_are_those_of_extensions():
    rng = np.random.default_rng(12)
    a, b = (rng.integers(1, 3, (30, 25)).astype(np.int32) for _ in range(2))
    b[:10] = np.where(rng.random((10, 25)) < 0.8, a[:10], b[:10])
    a[3, 7:] = b[4, 9:] = a[5] = b[5] = 0  # texts that end
    far, on = S._reaches(a, b)
    for i in range(30):
        for j in range(30):
            n, ended = S._extend(a[i][a[i] != 0], b[j][b[j] != 0])
            assert far[i, j] == n and (not on[i, j] or not ended)


def test_pairs_of_a_common_sentence_grow_with_what_they_share(spark, monkeypatch):
    """A sentence that is too short for a passage stands in 300 documents; of these a few pairs share more, with edits."""
    seen, crossed = [], S.crossed
    monkeypatch.setattr(S, "crossed", lambda *how: seen.append(crossed(*how)) or seen[-1])
    rng = random.Random(13)
    text = lambda n: [f"w{rng.randrange(10**7)}" for _ in range(n)]
    one, two = text(34), text(18)
    rows = [(i, " ".join(text(20) + one + text(20))) for i in range(300)] + [(i, " ".join(text(20) + two + text(20))) for i in range(300, 320)]
    tail = text(30)
    rows += [(1000, " ".join(text(9) + one + text(2) + tail)), (1001, " ".join(text(8) + one + text(2) + tail[:20] + text(9)))]
    rows += [(1002, " ".join(text(9) + one + text(3) + two + text(30))), (1003, " ".join(text(8) + one + text(4) + two + text(30)))]
    got = S.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).where("repeated").collect()
    assert {r.doc_id for r in got} == {1000, 1001, 1002, 1003}
    assert len(seen) == 1 and seen[0].count() < len(rows)


def test_a_text_of_several_chains_is_split_once(monkeypatch):
    texts, split, pieces = [], [], S.pieces
    monkeypatch.setattr(S, "pieces", lambda col, *how: split.append(len(col)) or pieces(col, *how))
    monkeypatch.setattr(S, "SLICED", 30)
    texts = [" ".join(f"w{i}" for i in range(n)) for n in (40, 0, 90)]
    rows = [(k, 0, lo, lo + 6, texts[r], r) for k, (r, lo) in enumerate([(0, 0), (0, 20), (0, 34), (2, 50)])]
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64())
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=list("abcdef"))
    got = [r for b in S._slice(iter([batch]), 5) for r in b.to_pylist()]
    assert split == [2] and [(r["pid"], r["at"], r["more"], len(r["words"])) for r in got] == [(0, 0, True, 11), (1, 15, True, 16), (2, 29, False, 11), (3, 45, True, 16)]
