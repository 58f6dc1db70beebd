import random
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from tideline.llm import packing as P
from tideline.llm.tokens import Encoder, default_path

ODD = ["a  b   c", "  x", "x ", "\n y", "a \n b", "a\n \nb", "<|endoftext|> a<|endoftext|>b", "don't  we'll", "a\t b", " ", "\n", "\x1c \x1d b", "a\x85 \x85b", "é ñ 😀", "1 2 3", "\0 \0", "x  y", "\n\nabc", None, ""]


def test_ids_are_those_of_whole_texts():
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice(["a", "Bc", "é", " ", " ", "\n", "'s", "!", "12", "\t", " "]) for _ in range(40)) for _ in range(400)]
    whole = Tokenizer.from_file(default_path())
    e = Encoder(default_path())
    for t in texts:
        assert e.encode(t) == np.array(whole.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes(), repr(t)


def check_plan(counts, room):
    left = dict(counts)
    seqs = 0
    for lengths, m in P.plan(counts, room):
        assert sum(lengths) <= room and m > 0
        seqs += m
        for x in lengths:
            left[x] -= m
    assert not any(left.values())
    return seqs


def test_plan():
    rng = random.Random(2)
    for _ in range(200):
        room = rng.choice([1, 2, 7, 16, 64])
        counts = {x: rng.choice([1, 2, 3, 50]) for x in rng.sample(range(1, room + 1), rng.randint(0, min(room, 9)))}
        seqs = check_plan(counts, room)
        least = -(-sum(x * n for x, n in counts.items()) // room)
        assert least <= seqs <= 1.7 * least + 1
    assert check_plan({5: 2, 3: 2, 2: 2}, 10) == 2
    many = {x: rng.randint(1, 10**9) for x in range(1, 1025)}
    least = max(sum(x * n for x, n in many.items()) / 1024, sum(n for x, n in many.items() if x > 512))  # two such never share
    assert check_plan(many, 1024) <= 1.01 * least


def test_pieces_and_places(spark):
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice(["the ", "of ", "zqx ", "\n"]) for _ in range(rng.randint(1, 200))) for _ in range(60)] + ["same text here"] * 30 + ["w " * 3000]
    rows = [(i, t, 5, 6) for i, t in enumerate(texts)] + [(3, texts[3], 5, 6), (None, "x", 5, 6)]
    got = P.best_fit_pack(spark.createDataFrame(rows, "doc_id long, text string, length int, `offset` int"), room=32).collect()
    whole = Tokenizer.from_file(default_path())
    want = []
    for i, t, *_ in rows:
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        n = max(1, -(-len(ids) // 32))
        first = len(ids) - 32 * (n - 1)
        for k in range(n):
            a, b = (0, first) if k == 0 else (first + 32 * (k - 1), first + 32 * k)
            want.append((i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in got)
    seqs = defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    for s in seqs.values():
        s.sort()
        assert [o for o, _ in s] == [sum(x for _, x in s[:i]) for i in range(len(s))] and s[-1][0] + s[-1][1] <= 32
    assert len(seqs) <= 1.2 * sum(r.length for r in got) / 32
    assert P.best_fit_pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
