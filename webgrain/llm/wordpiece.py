"""Token ids by the tokenizers library with a cache of pieces between white space.

The vocabularies used here drop white space and never merge across it, so a text's ids are the
ids of its pieces one after the other. Pieces recur, so a worker keeps the ids of those it has
met lately, up to CACHE_BYTES. A piece of plain letters and marks goes straight to the library's
model, any other piece through the library's whole chain, and so does a whole text that has one of
the vocabulary's special tokens, in upper or lower case. Letters with marks after them are kept apart
too, so that "word", "word," and "Word." ask the model once for the letters.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable

import numpy as np
from tokenizers import Tokenizer

from webgrain.llm.caches import held

#: Texts with these are handed over whole or without lower-casing first: control characters that
#: only Python counts as white space, and all from the combining marks on.
_CONTROL = re.compile("[\x1c-\x1f]")
_BEYOND = re.compile("[̀-\U0010ffff]")
_PLAIN = re.compile(r"([a-zß-öø-ÿ]*)([!-/:-@\[-`{-~]*)")
_UPPER = bytes(range(65, 91)), bytes(range(97, 123))
#: What the pieces that a worker keeps may take; each ENTRY_BYTES (an estimate) besides its letters and ids.
CACHE_BYTES, ENTRY_BYTES = 48 << 20, 200


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, spare = {b: chr(b) for b in shown}, 0x100
    for b in range(256):
        if b not in letters:
            letters[b], spare = chr(spare), spare + 1
    return [letters[b] for b in range(256)]


class _Pieces(dict):
    """Pieces and their ids; what is not there is asked for, once, where it is looked up."""

    __slots__ = ("find",)

    def __init__(self, find: Callable[[str], bytes]):
        super().__init__()
        self.find = find

    def __missing__(self, piece: str) -> bytes:
        ids = self[piece] = self.find(piece)
        return ids


class PieceEncoder:
    """encode(text): the ids as the bytes of little-endian unsigned integers of `width` bytes."""

    def __init__(self, vocabulary: bytes, cache_bytes: int = CACHE_BYTES):
        self.tokenizer = Tokenizer.from_str(vocabulary.decode("utf-8"))
        self.model, self.half, self.used = self.tokenizer.model, cache_bytes // 2, 0
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.width, self.code = self.dtype.itemsize, "H" if self.dtype.itemsize == 2 else "I"
        self.letters = byte_letters()
        self.pieces = _Pieces(self._find)  # those met lately
        self.before: dict[str, bytes] = {}  # those met before that
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.marks = {t[0] for t in special}
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)", re.IGNORECASE)

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _find(self, piece: str) -> bytes:
        ids = self.before.get(piece) or self._piece(piece)
        self.used += ENTRY_BYTES + len(piece) + len(ids)
        return ids

    def _run(self, run: str) -> bytes:
        shown = run if run.isascii() else "".join([self.letters[b] for b in run.encode()])
        return array(self.code, [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _piece(self, piece: str) -> bytes:
        low = piece.lower()
        if not (low.isascii() and low.isalpha()):
            plain = _PLAIN.fullmatch(low)
            if plain is None:
                return self._ids(piece)
            letters, marks = plain.groups()
            if letters and marks:
                return self.pieces[letters] + self.pieces[marks]
        return self._run(low) if low == piece else self.pieces[low]

    def encode(self, text: str) -> bytes:
        if _CONTROL.search(text) or any(m in text for m in self.marks) and self.special.search(text):
            return self._ids(text)
        if not _BEYOND.search(text):
            text = text.encode().translate(bytes.maketrans(*_UPPER)).decode()
        if self.used > self.half:
            self.pieces, self.before, self.used = _Pieces(self._find), self.pieces, 0
        return b"".join(map(self.pieces.__getitem__, text.split()))


def encoder(vocabulary: bytes) -> PieceEncoder:
    """One encoder for each worker process and vocabulary; what it keeps goes when the worker turns to another operator."""
    return held("wordpiece", vocabulary, lambda: PieceEncoder(vocabulary))
