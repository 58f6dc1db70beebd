import hashlib
import random
import re
import time
import zlib

import pytest
from tideline.llm import periodic_runs as R


def plain_runs(w, times=4, least=6):
    """Every maximal stretch by its definition, and only those of the smallest period."""
    found = []
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            s = w[i : j + q]
            if j - i + q >= max(least, times * q) and not any(all(s[k] == s[k + d] for k in range(len(s) - d)) for d in range(1, q)):
                found.append((i, j - i + q, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0d]+", text or "")
    h, n = zlib.crc32(("" if doc_id is None else str(doc_id)).encode()), len(w)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    drop = {k for s, m, q in runs for k in range(s + q, s + m)}
    s, m, q = max(runs, key=lambda r: (r[1], -r[0], -r[2])) if runs else (None, None, None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (str(doc_id), len(runs), s, m, q, 1000 * m // q if runs else None, sha("".join("%d,%d,%d\n" % r for r in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in drop)))


def test_lyndon_arrays_by_definition():
    r = random.Random(1)
    for _ in range(400):
        w = [r.randrange(r.choice([1, 2, 3, 9])) for _ in range(r.randrange(1, 30))]
        is_lyndon = lambda x: all(x < x[k:] for k in range(1, len(x)))
        assert R.lyndon(w) == [max(k for k in range(1, len(w) - i + 1) if is_lyndon(w[i : i + k])) for i in range(len(w))]


def words_of(r):
    kind = r.randrange(5)
    few = lambda k, n: [b"%d" % r.randrange(k) for _ in range(n)]
    if kind == 0:
        return few(2, r.randrange(60))
    if kind == 1:
        root = few(3, r.randrange(1, 6))
        return few(4, 5) + root * r.randrange(2, 9) + root[: r.randrange(3)] + few(4, 5) + root * 4
    if kind == 2:
        a, b = [b"a"], [b"b"]
        for _ in range(r.randrange(9)):
            a, b = a + b, a
        return a
    if kind == 3:
        return (few(2, 3) * 5 + [b"x"]) * 5 + few(2, 20)
    return few(50, 40) + [b"same"] * r.randrange(12) + few(50, 20)


def test_runs_by_definition():
    r = random.Random(2)
    some = 0
    for k in range(1500):
        w, (times, least) = words_of(r), r.choice([(4, 6), (2, 2), (3, 5)])
        want = plain_runs(w, times, least)
        assert R.find(w, times, least) == want, (w, times)
        rank = {x: i for i, x in enumerate(sorted(set(w)))}
        assert sorted(R.runs_of([rank[x] for x in w], times, least), key=lambda x: (x[0], x[2])) == want
        some += len(want)
    assert some > 2000


@pytest.mark.parametrize("w", [[b"a"] * 200_000, [b"a", b"b", b"c"] * 70_000, ([b"a"] * 40 + [b"b"]) * 5_000, [b"%d" % (i % 997) for i in range(200_000)]])
def test_long_texts_in_linear_time(w):
    began = time.process_time()
    runs = R.find(w)
    assert max(m for _, m, _ in runs) == len(w)
    assert time.process_time() - began < 20


def rows_of(n):
    r = random.Random(4)
    kinds = [lambda: b" ".join(words_of(r)).decode(), lambda: "é ü\t".join("abc") + "\n la la la la la la", lambda: "", lambda: None, lambda: "one  two\x0bthree\x1fx " * r.randrange(6)]
    return [(i, kinds[i % 5]()) for i in range(n)] + [(None, "a a a a a a a"), (None, None), (3, "x y " * 9), (3, "x y " * 9), (7, "no break " * 3)]


def digest(r):
    return (str(r["doc_id"]), *(r[c] for c in ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")))


def test_rows_with_nulls_and_clashing_columns(spark, tmp_path):
    names = "doc_id long, text string, n_words string, runs string, collapsed string, start string"
    rows = rows_of(300)
    spark.createDataFrame([(*x, "a", "b", "c", "d") for x in rows], names).write.parquet(f"{tmp_path}/documents.parquet")
    got = R.op11_periodic_runs(spark, str(tmp_path)).collect()
    assert sorted(map(digest, got), key=str) == sorted((plain_row(*x) for x in rows), key=str)


def test_real_outputs_and_empty_table(spark, docs):
    (row,) = R.periodic_runs(docs([(1, "go  now la la\nla la la la stop")])).collect()
    assert (row["n_words"], [tuple(x) for x in row["runs"]], row["collapsed"]) == (9, [(2, 6, 1)], "go now la stop")
    assert R.periodic_runs(docs([])).collect() == []


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = sorted(plain_row(*x) for x in rows if len(x[1] or "") < 5000)
    ids = {w[0] for w in want}
    got = [digest(r) for r in R.op11_periodic_runs(spark, sf).collect()]
    assert len(got) == len(rows) and sorted(g for g in got if g[0] in ids) == want and any(w[1] for w in want)
