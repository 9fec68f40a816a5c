"""Fast exact front ends of two kinds of byte-level BPE files of the ``tokenizers`` library.

Both cut a text into pieces that the library treats alone, look each piece up in a bounded
memory and run the library's merges on unknown pieces only. Texts with characters or strings
for which that is not proven go to the library whole.
"""

from __future__ import annotations

import functools
import re
import struct

import regex
from tokenizers import Tokenizer

#: Pieces that a worker remembers at least, and half of what it remembers at most.
MEMORY = 300_000

#: Characters below U+0300 but for those on whose kind (white space or not) libraries differ.
#: None of them composes with another, so NFC leaves texts of them alone.
_UNPROVEN = re.compile("[^\x00-\x1b\x20-\x84\x86-˿‐-‧€]")
_SPECIAL = "<|"
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
_SPACED = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_ODD_SPACE = re.compile(r" \s|\s |\A\s|\s\Z")
_PIECES = re.compile(r" ?\S+|\s+(?!\S)|\s+")


def _alphabet() -> dict[int, int]:
    """Code point by which a byte-level vocabulary writes each byte."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: b for b in shown} | {b: 256 + k for k, b in enumerate(hidden)}


ALPHABET = _alphabet()


def as_bytes_text(piece: str) -> str:
    if piece.isascii() and piece.isalnum():
        return piece  # written as it is
    return piece.encode().decode("latin-1").translate(ALPHABET)


@functools.lru_cache(maxsize=4)
def load(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


def whole_tokens(path: str) -> frozenset[str]:
    """Vocabulary strings (in the byte alphabet) that the merges keep as one token.

    Run once, before any text is read: each string goes through the model alone, so a
    pre-token found here is known to be one token.
    """
    model = load(path).model
    vocab = load(path).get_vocab(with_added_tokens=False)
    return frozenset(s for s, i in vocab.items() if [t.id for t in model.tokenize(s)] == [i])


class Memory(dict):
    """A dict of two generations: when the young one is full it becomes the old one, so pieces
    in use stay and the size is bounded. ``make`` gives the value of a piece it doesn't hold."""

    def __init__(self, make, size: int = MEMORY):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, piece):
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        value = self.old.get(piece)
        if value is None:
            value = self.make(piece)
        self[piece] = value
        return value

    def all(self, pieces: list[str]) -> list:
        found = list(map(self.get, pieces))
        if None in found:
            for k in [k for k, v in enumerate(found) if v is None]:
                found[k] = self[pieces[k]]
        return found


class SpacedCounter:
    """Token counts for a byte-level file whose pre-tokens carry their leading space."""

    def __init__(self, path: str, whole: frozenset[str]):
        self.tokenizer = load(path)
        self.model = self.tokenizer.model
        self.whole = whole
        self.after_space = Memory(lambda p: self._piece(" " + p))
        self.pieces = Memory(self._piece)
        self.merged = Memory(lambda s: len(self.model.tokenize(s)))

    def _merge(self, pre_token: str) -> int:
        s = as_bytes_text(pre_token)
        return 1 if s in self.whole else self.merged[s]

    def _piece(self, piece: str) -> int:
        return sum(map(self._merge, _SPACED.findall(piece)))

    def count(self, text: str) -> int:
        if not text:
            return 0
        if _SPECIAL in text or _UNPROVEN.search(text):
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if _ODD_SPACE.search(text):
            return sum(self.pieces.all(_PIECES.findall(text)))
        # every space stands alone between two solid characters, so pieces end where spaces are
        first, *rest = text.split(" ")
        return self._piece(first) + sum(self.after_space.all(rest))


class WordEncoder:
    """Ids, as little-endian unsigned 32-bit integers, for a lower-casing file that drops white space."""

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.model = self.tokenizer.model
        self.chunks = Memory(self._chunk)

    def _word(self, word: str) -> bytes:
        tokens = self.model.tokenize(as_bytes_text(word))
        return struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])

    def _chunk(self, chunk: str) -> bytes:
        words = [chunk] if chunk.isalpha() else _WORDS.findall(chunk)
        return self._word(chunk) if words == [chunk] else b"".join([self.chunks[w] for w in words])

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if _SPECIAL in text or _UNPROVEN.search(text):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        return b"".join(self.chunks.all(text.lower().split()))
