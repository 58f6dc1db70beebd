import re

import pyarrow as pa

from tideline.llm import words as W

TEXTS = [None, "", " ", "One", "a  B\tc", "é x", "z " * 500, "q" * 3_000_000, "tail"]
M = (1 << 64) - 1


def direct(w: bytes) -> int:
    h = sum(int(W._VALUE[b]) * pow(int(W._BASE), i, 1 << 64) for i, b in enumerate(w)) + len(w) & M
    return int(W.mix([h])[0])


def test_hashes_are_the_sums_over_each_words_bytes():
    short = [t for t in TEXTS if t is None or len(t) < 2000]
    for size in (8, 100, W.PIECE):
        got = [[int(h) for h in p.hashes[p.begin[i] : p.begin[i + 1]]] for p in W.pieces(pa.array(short), W.SPACED, size) for i in range(p.rows)]
        lower = [re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()) for t in short]
        assert got == [[direct(w) for w in re.findall(rb"[^\x20\x09-\x0D]+", t)] for t in lower]


def test_long_words_and_texts_hash_as_short_ones():
    word = "q" * 3_000_000
    for text in (word + " One z", f"One {word} z " + "z " * 1_500_000):
        (p,) = W.pieces(pa.array([text]), W.SPACED)
        known = {t: int(next(W.pieces(pa.array([t]), W.SPACED)).hashes[0]) for t in (word, "One", "z")}
        assert [int(h) for h in p.hashes] == [known[t] for t in text.split()]


def test_long_words_of_repeating_structure_differ():
    word = "ab"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
        other = word.translate(str.maketrans("ab", "ba"))
        hashes = [h for p in W.pieces(pa.array([word, other, f"x {word.upper()}"]), W.SPACED, 64) for h in p.hashes.tolist()]
        a, b, _, c = hashes
        assert a != b and a == c
    many = [word[i : i + 70] for i in range(0, 600)] * 2
    (p,) = W.pieces(pa.array([" ".join(many)]), W.SPACED)
    assert len(set(p.hashes.tolist())) == len(set(many))
