"""Byte-level BPE ids at the speed of dictionary look-ups.

A byte-level pre-tokenizer never joins a space to the token before it, so a text can be cut at every
single space that stands between two non-spaces, each piece encoded on its own and the ids joined: the
result equals encoding the whole text. Pieces repeat, so a bounded cache holds their ids. A piece of
letters only is one pre-token and goes straight to the library's BPE model; any other goes through the
whole library pipeline. A text with a space beside other white space is cut with more care, and one that holds
an added token of the vocabulary (such as ``<|endoftext|>``) is not cut: ids are those of the library's own call.
"""

from __future__ import annotations

import os
import re
import string
import sys
from array import array

from .common import kept

END_ID = 2
#: Pieces in each of the two generations that a worker keeps, and the longest piece worth keeping.
CACHE_PIECES = 200_000
CACHE_CHARS = 48
#: Places where a piece leaves a mark the first time it is encoded.
SEEN_MARKS = 1 << 21

_CUT = re.compile(r"(?<=\S) (?=\S)")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[int, str]:
    """The byte-level alphabet by its rule: printable Latin-1 stands for itself, the rest for 256 onwards."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


def _packed(ids: list[int]) -> bytes:
    packed = array("I", ids)
    if sys.byteorder != "little":
        packed.byteswap()
    return packed.tobytes()


class _Spaced(Exception):
    """A piece starts or ends with white space: the simple cut does not hold."""


class PieceEncoder(dict):
    """Encodes texts to little-endian unsigned 32-bit ids, as bytes, without special tokens."""

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.alphabet = byte_alphabet()
        # the library finds added tokens anywhere in a text: texts that hold one go through it whole
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.highest = max(self.tokenizer.get_vocab(with_added_tokens=True).values(), default=0)
        self.older: dict[str, bytes] = {}
        self.seen = bytearray(SEEN_MARKS)
        self.tails: dict[str, bytes] = {}
        self.space = self.alphabet[32]
        self.newline = self._whole("\n")

    def _whole(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _letters(self, word: str, space: str) -> bytes:
        """Ids of letters only, after a space or none: one pre-token."""
        mapped = word if word.isascii() else word.encode("utf-8", "replace").decode("latin-1").translate(self.alphabet)
        return _packed([t.id for t in self.model.tokenize(space + mapped)])

    def _tail(self, marks: str) -> bytes:
        ids = self.tails.get(marks)
        if ids is None:
            ids = self._whole(marks)
            if len(marks) <= 4:
                self.tails[marks] = ids
        return ids

    def _word(self, word: str, space: str) -> bytes:
        """Ids of a piece without white space, after a space or none."""
        if word.isalpha():
            return self._letters(word, space)
        stem = word.rstrip(string.punctuation)
        if stem.isalpha():
            return self._letters(stem, space) + self._tail(word[len(stem) :])
        return self._whole(" " + word if space else word)

    def __missing__(self, piece: str) -> bytes:
        """``piece`` followed a space, which it carries."""
        ids = self.older.get(piece)
        again = ids is not None
        if ids is None:
            if not piece or piece[0].isspace() or piece[-1].isspace():
                raise _Spaced
            left, newline, right = piece.partition("\n")
            if not newline:
                ids = self._word(piece, self.space)
            elif left[-1].isspace() or right[0].isspace() or "\n" in right:
                ids = self._whole(" " + piece)
            else:
                return self[left] + self.newline + self._word(right, "")
        if len(piece) <= CACHE_CHARS:
            mark = hash(piece) % SEEN_MARKS
            if not again and not self.seen[mark]:
                self.seen[mark] = 1  # most rare pieces never come again: held from the second time on
                return ids
            if len(self) >= CACHE_PIECES:
                self.older = dict(self)
                self.clear()
                self.seen = bytearray(SEEN_MARKS)
            self[piece] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """Null and empty texts have no ids."""
        if not text:
            return b""
        if any(t in text for t in self.added):
            return self._whole(text)
        try:
            head, *rest = text.split(" ")
            if not head or head[-1].isspace():
                raise _Spaced
            return self._whole(head) + b"".join(map(self.__getitem__, rest))
        except _Spaced:
            head, *rest = _CUT.split(text)
            return self._whole(head) + b"".join([self[p] if len(p) <= CACHE_CHARS and not p[-1].isspace() else self._whole(" " + p) for p in rest])


def encoder(path: str) -> PieceEncoder:
    """One encoder per worker process and vocabulary, while no other operator has the worker."""
    encoders = kept("tokens")
    if path not in encoders:
        encoders[path] = PieceEncoder(path)
    return encoders[path]
