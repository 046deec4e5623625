"""Token ids of whole texts by a published byte-level byte-pair vocabulary.

Before a single space between two other characters the vocabulary's own splitting rule always
cuts, so a text is cut there, and each different chunk is tokenized once and remembered.
"""

from __future__ import annotations

import json
import re

import numpy as np
import tiktoken
from tokenizers import Tokenizer

#: The splitting rule of this vocabulary family (fixed value).
_RULE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A place before a single space with plain signs on both sides.
_PLAIN_CUT = re.compile(rb"(?<=[!-~])(?= [!-~])")
#: White space so long goes to the vocabulary's own tokenizer.
_LONG_GAP = re.compile(r"\s{2000}")
_MOST = 400_000  # remembered chunks; then the memory starts anew


class ByteBpe:
    """``ids(text)``: the token ids as little-endian unsigned 32-bit numbers, for a text in UTF-8."""

    def __init__(self, spec: str):
        self._tokenizer = Tokenizer.from_str(spec)
        parts = json.loads(spec)
        byte_of = {letter: value for value, letter in enumerate(_letters())}
        self._special = [t["content"].encode() for t in parts["added_tokens"]]
        ranks = {
            bytes(byte_of[c] for c in symbol): number
            for symbol, number in parts["model"]["vocab"].items()
            if symbol.encode() not in self._special
        }
        encoding = tiktoken.Encoding("bytes", pat_str=_RULE, mergeable_ranks=ranks, special_tokens={})
        self._encode, self._merge = encoding.encode_ordinary, encoding._core_bpe.encode_single_piece
        self._one = {number: number.to_bytes(4, "little") for number in ranks.values()}
        self._known: dict[bytes, bytes] = {}

    def ids(self, text: bytes) -> bytes:
        if any(s in text for s in self._special):
            return _packed(self._tokenizer.encode(text.decode(), add_special_tokens=False).ids)
        if len(self._known) > _MOST:
            self._known.clear()
        first, *chunks = text.split(b" ")
        known = self._known
        for chunk in set(chunks).difference(known):
            letters, sign = (chunk[:-1], chunk[-1:]) if chunk[-1:] in (b",", b".") else (chunk, b"")
            if letters.isalpha():  # plain Latin letters, perhaps with one sign: pieces of their own
                merged = self._merge(b" " + letters) + (self._merge(sign) if sign else [])
                known[chunk] = b"".join([self._one[k] for k in merged])
                continue
            word = chunk.decode()
            if not word or word != word.strip():
                return self._spaced(text)
            known[chunk] = _packed(self._encode(" " + word))
        start = first.decode()
        if chunks and start != start.rstrip():
            return self._spaced(text)
        return b"".join([_packed(self._encode(start)), *[known[c] for c in chunks]])

    def _spaced(self, text: bytes) -> bytes:
        """A text with runs of white space: cut only where plain signs surround one space."""
        if _LONG_GAP.search(text.decode()):
            return _packed(self._tokenizer.encode(text.decode(), add_special_tokens=False).ids)
        known, found = self._known, []
        for k, chunk in enumerate(_PLAIN_CUT.split(text)):
            remembered = known.get(chunk[1:]) if k else None
            found.append(remembered if remembered is not None else _packed(self._encode(chunk.decode())))
        return b"".join(found)


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, dtype="<u4").tobytes()


def _letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(value if value in shown else next(spare)) for value in range(256)]


_loaded: dict[int, ByteBpe] = {}


def byte_bpe(spec: str) -> ByteBpe:
    """The vocabulary of this specification, built once in a Python worker."""
    key = hash(spec)
    if key not in _loaded:
        _loaded[key] = ByteBpe(spec)
    return _loaded[key]
