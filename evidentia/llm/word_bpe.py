"""Token ids of whole texts by a published word-level byte-pair vocabulary.

The vocabulary's own tokenizer is exact but slow on long texts. Its pieces never
reach over white space, so a text is cut there and each different chunk is tokenized once
and remembered. Chunks of plain Latin letters, digits and signs take a fast merge
of the same vocabulary; any other chunk goes to the tokenizer itself.
"""

from __future__ import annotations

import json
import re

import numpy as np
import regex
import tiktoken
from tokenizers import Tokenizer

#: Characters on which normal forms, lower case and classes are the same everywhere.
_PLAIN = re.compile(r"[\x21-\x7eÀ-įı-ɏ]+")
_WORD_END = b"\xff"  # never part of UTF-8
_MOST = 100_000  # remembered chunks, some 20 MB; then the memory starts anew


class WordBpe:
    """``ids(text)``: the token ids as little-endian unsigned 32-bit numbers."""

    def __init__(self, spec: str):
        self._tokenizer = Tokenizer.from_str(spec)
        parts = json.loads(spec)
        self._pieces = regex.compile(parts["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self._special = tuple(t["content"] for t in parts["added_tokens"])
        vocabulary, suffix = parts["model"]["vocab"], parts["model"]["end_of_word_suffix"]
        byte_of = _byte_letters()

        def raw(symbol: str) -> bytes:
            ends = symbol.endswith(suffix)
            return bytes(byte_of[c] for c in (symbol[: -len(suffix)] if ends else symbol)) + _WORD_END * ends

        # Letters, then letters that end a word, then the merges in their order.
        single = [bytes([b]) for b in range(256)]
        ranked = single + [b + _WORD_END for b in single] + [raw(a + b) for a, b in parts["model"]["merges"]]
        ranks = {}
        for piece in ranked:
            ranks.setdefault(piece, len(ranks))
        self.size = 1 + max(vocabulary.values())  # ids are below
        of_piece = {raw(symbol): number for symbol, number in vocabulary.items() if symbol not in self._special}
        self._ids = [of_piece.get(piece, 0).to_bytes(4, "little") for piece in ranks]
        self._merge = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self._known: dict[bytes, bytes] = {}

    def ids(self, text: bytes) -> bytes:
        chunks = text.split()
        known = self._known
        missing = [c for c in chunks if c not in known]
        if missing:
            if len(known) > _MOST:
                known.clear()
                missing = chunks
            for chunk in dict.fromkeys(missing):
                known[chunk] = self._chunk(chunk)
        return b"".join([known[c] for c in chunks])

    def _chunk(self, chunk: bytes) -> bytes:
        if chunk.isalpha():
            return self._piece(chunk.lower())
        if chunk[:-1].isalpha() and chunk[-1] in b",.":
            return self._piece(chunk[:-1].lower()) + self._piece(chunk[-1:])
        word = chunk.decode()
        if not _PLAIN.fullmatch(word) or any(s in word for s in self._special):
            return np.array(self._tokenizer.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()
        word = word.lower()
        if word.isalpha():
            return self._piece(word.encode())
        return b"".join([self._piece(piece.encode()) for piece in self._pieces.findall(word)])

    def _piece(self, piece: bytes) -> bytes:
        return b"".join([self._ids[k] for k in self._merge(piece + _WORD_END)])


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


_loaded: dict[int, WordBpe] = {}


def word_bpe(spec: str) -> WordBpe:
    """The vocabulary of this specification, built once in a Python worker."""
    key = hash(spec)
    if key not in _loaded:
        _loaded[key] = WordBpe(spec)
    return _loaded[key]
