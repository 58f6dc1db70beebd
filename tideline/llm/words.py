"""Words of whole texts as 64-bit numbers, computed over Arrow buffers.

Texts stay UTF-8 bytes: all word patterns used here are classes of bytes, with every byte of a multi-byte character on
the same side. A-Z become lower case. The functions work on one Arrow batch and in pieces of bounded size."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
PIECE = 1 << 20  # bytes of text handled at a time; a longer text is a piece of its own
LONG = 64  # bytes; words from here on have a second sum, as sums of powers agree for some long ones (Thue-Morse words)
_rng = np.random.default_rng(20240229)
_VALUE = _rng.integers(1, 2**63, 256, dtype=U64) * U64(2) + U64(1)
_BASE = U64(0x9E3779B97F4A7C15)
_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes that words consist of.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64's finisher)."""
    x = np.asarray(x, U64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers(base: int, n: int, kept: dict = {}) -> np.ndarray:  # noqa: B006
    """base ** 0, 1, ..., n - 1 at least; those of a usual piece are kept."""
    p = kept.get(base, np.ones(1, U64))
    while len(p) < n:
        p = np.concatenate([p, p * (p[-1:] * U64(base))])
        if len(p) <= 2 * PIECE:
            kept[base] = p
    return p


@dataclass
class Piece:
    """Some texts of a batch: first row, their words' hashes, where each row's words begin, and the words' bytes."""

    row: int
    rows: int
    hashes: np.ndarray  # uint64, one a word
    begin: np.ndarray  # int64, rows + 1
    data: np.ndarray  # lower-cased bytes
    start: np.ndarray  # int64, first byte of each word
    stop: np.ndarray
    raw: np.ndarray  # bytes as they came
    off: np.ndarray  # int64, where each row's bytes begin, rows + 1

    def doc(self) -> np.ndarray:
        """Row within the piece of each word."""
        return np.repeat(np.arange(self.rows), np.diff(self.begin))


def buffers(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string()).fill_null("")
    off = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8) if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if len(col) and col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, off


def pieces(col: pa.Array | pa.ChunkedArray, inside: np.ndarray, size: int = PIECE) -> Iterator[Piece]:
    """Split every text into words, maximal runs of the bytes that ``inside`` marks, and hash them."""
    data, off = buffers(col)
    row, n = 0, len(off) - 1
    while row < n:
        last = max(row + 1, int(np.searchsorted(off, off[row] + size, "right")) - 1)
        yield _piece(data[off[row] : off[last]], off[row : last + 1] - off[row], inside, row)
        row = last


def _hashes(b: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Of each word the sum of value * _BASE ** place in it: from running sums over places in some words' bytes, moved to
    the word's own places by the inverse."""
    out, i = np.empty(len(start), U64), 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(stop, start[i] + 2 * PIECE, "right")))
        at, n = start[i], int(stop[j - 1] - start[i])
        total = np.zeros(n + 1, U64)
        term = _VALUE[b[at : at + n]]
        term *= _powers(_BASE, n)[:n]
        np.cumsum(term, out=total[1:])
        first = start[i:j] - at
        out[i:j] = (total[stop[i:j] - at] - total[first]) * _powers(_INVERSE, n)[first]
        i = j
    return out


def _second(b: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Of each word the sum of a mix of place and byte, which has no structure that repeats from place to place."""
    out, i = np.zeros(len(start), U64), 0
    while i < len(start):
        j = max(i + 1, i + int(np.searchsorted(np.cumsum(stop[i : i + PIECE] - start[i : i + PIECE]), PIECE, "right")))
        if j == i + 1:  # one word, however long
            for at in range(int(start[i]), int(stop[i]), PIECE):
                part = b[at : min(at + PIECE, int(stop[i]))]
                out[i : i + 1] += mix(np.arange(at - start[i], at - start[i] + len(part)).astype(U64) * U64(256) + part).sum(keepdims=True)
        else:
            size = stop[i:j] - start[i:j]
            begin = np.cumsum(size) - size
            place = np.arange(int(size.sum())) - np.repeat(begin, size)
            of = b[place + np.repeat(start[i:j], size)]
            out[i:j] = np.add.reduceat(mix(place.astype(U64) * U64(256) + of), begin)
        i = j
    return out


def _piece(raw: np.ndarray, off: np.ndarray, inside: np.ndarray, row: int) -> Piece:
    lower = raw.tobytes().translate(_LOWER.tobytes())
    b = np.frombuffer(lower, np.uint8)
    rows, n = len(off) - 1, len(b)
    if not n:
        none = np.zeros(0, np.int64)
        return Piece(row, rows, np.zeros(0, U64), np.zeros(rows + 1, np.int64), b, none, none, raw, off)
    word = np.frombuffer(lower.translate(inside.tobytes()), bool)
    edge = np.zeros(n + 1, bool)
    edge[off] = True  # a text ends here
    before = np.concatenate([[False], word[:-1]])
    start = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.concatenate([word[1:], [False]])
    stop = np.flatnonzero(word & (~after | edge[1:])) + 1
    begin = np.searchsorted(start, off)
    if not len(start):
        return Piece(row, rows, np.zeros(0, U64), begin, b, start, stop, raw, off)
    h = _hashes(b, start, stop) + (stop - start).astype(U64)
    long = np.flatnonzero(stop - start >= LONG)
    if len(long):
        h[long] += mix(_second(b, start[long], stop[long]))
    return Piece(row, rows, mix(h), begin, b, start, stop, raw, off)


def grams(p: Piece, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the k words from each word on, and whether these lie within one text."""
    h, n = p.hashes, len(p.hashes)
    if n < k:
        return np.zeros(n, U64), np.zeros(n, bool)
    out = np.zeros(n, U64)
    out[: n - k + 1] = gram_hash([h[i : n - k + 1 + i] for i in range(k)])
    return out, np.arange(n) + k <= p.begin[1:][p.doc()]


def span_hash(p: Piece, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hash of the words from each ``start`` to its ``stop`` (places in ``hashes``), by running sums; for short spans."""
    n = len(p.hashes)
    total = np.zeros(n + 1, U64)
    np.cumsum(p.hashes * _powers(_BASE, n)[:n], out=total[1:])
    return mix((total[stop] - total[start]) * _powers(_INVERSE, n + 1)[start] + (stop - start).astype(U64))


def gram_hash(words: list[np.ndarray]) -> np.ndarray:
    """Of several words in a row; ``words[i]`` has the i-th word of each."""
    out = np.full(len(words[0]), U64(0x2545F4914F6CDD1D) + U64(len(words)), U64)
    for w in words:
        out = mix(out * U64(0xD6E8FEB86659FD93) + w)
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, U64).view(np.int64)


def lists(flat: np.ndarray, begin: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    return pa.LargeListArray.from_arrays(pa.array(np.asarray(begin, np.int64)), pa.array(flat, kind)).cast(pa.list_(kind or pa.array(flat[:0]).type))
