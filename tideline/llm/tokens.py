"""Token ids of whole texts under a byte-level BPE file of ``tokenizers``, with the ids of recurring words kept.

The byte-level pattern begins a new token at every single white space, so a text is cut before each space and line feed
and each piece is encoded once per worker; for such short pieces ``tiktoken`` runs the same vocabulary in a third of
the time. Texts with two white spaces in a row, or with the special token, go whole to ``tokenizers``. The ids are
those of encoding the whole text with ``tokenizers`` (tested)."""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache

import numpy as np

_SPACE = "\u2581"  # fixed: how the library writes a space
_ODD = re.compile(r"\s\s|\s\Z|<\|endoftext\|>")
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""  # fixed: the byte-level pattern
KEPT = 200_000  # pieces of a generation; a worker keeps two, the one that it fills and the one before


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _visible() -> dict[str, int]:
    """The printable character that byte-level BPE files use for each byte, the other way round."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Kept(dict):
    """Maps a piece of text to the bytes of its ids; fills itself from ``made``."""

    def __init__(self):
        super().__init__()
        self.old: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.made(piece)
        if len(self) >= KEPT:
            self.old = dict(self)
            self.clear()
        self[piece] = ids
        return ids

    def joined(self, text: str) -> bytes:
        # The first piece has no space before it: no other begins with two line feeds.
        return b"".join(map(self.__getitem__, ("\n\n" + text.replace("\n", " \n")).split(" ")))


class Encoder(Kept):
    """The ids of a byte-level BPE file. With ``plain``, a special token's string in a text is text."""

    def __init__(self, path: str, plain: bool = False):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        special = {t["content"] for t in file["added_tokens"]}
        if special - {"<|endoftext|>"}:
            raise ValueError(f"unexpected special tokens in {path}")
        byte = _visible()
        ranks = {bytes(byte[c] for c in t): i for t, i in file["model"]["vocab"].items() if t not in special}
        self.bytes = [*(x for x, _ in sorted(ranks.items(), key=lambda r: r[1]))]
        self.short = tiktoken.Encoding("pieces", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def made(self, piece: str) -> bytes:
        text = piece[2:] if piece.startswith("\n\n") else piece if piece.startswith("\n") else " " + piece
        return array("I", self.short(text)).tobytes()

    def token_bytes(self) -> list[bytes]:
        """Of each id but those of special tokens, which must be the last."""
        return self.bytes

    def encode(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids; null counts as empty."""
        if not text:
            return b""
        if _ODD.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.joined(text)


class PieceEncoder(Kept):
    """The ids of a ``sentencepiece`` file for a text that begins with a space, which is that the library puts there.

    None of the file's pieces has a space after another character, or a line feed, so a text is cut before each."""

    def __init__(self, path: str):
        super().__init__()
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.whole = any("\n" in x or _SPACE in x.lstrip(_SPACE) for x in names)
        self.line = array("I", self.model.encode("\n")[:1]).tobytes()  # the space before a line feed
        self.bytes = [bytes([int(x[3:5], 16)]) if self.model.is_byte(i) else b"" if self.model.is_control(i) else x.replace(_SPACE, " ").encode() for i, x in enumerate(names)]

    def made(self, piece: str) -> bytes:
        ids = array("I", self.model.encode(piece[2:] if piece.startswith("\n\n") else piece)).tobytes()
        return ids[len(self.line) :] if piece.startswith("\n") and not piece.startswith("\n\n") else ids

    def token_bytes(self) -> list[bytes]:
        return self.bytes

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of a text that begins with a space."""
        if self.whole or _SPACE in text or _ODD.search(text):
            return array("I", self.model.encode(text[1:])).tobytes()
        return b"".join(map(self.__getitem__, text[1:].replace("\n", " \n").split(" ")))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each worker process and file."""
    return Encoder(path)
