"""Words of whole texts as 64-bit hashes, computed on the bytes of Arrow string columns.

A text is never cut into Python strings: one lookup lower-cases A-Z, a second
one tells separators, and a rolling polynomial over the bytes gives the hash of
each word. Windows of about a megabyte, cut between words, bound the memory.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_WINDOW = 1 << 20
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x = x * _M2
    x ^= x >> np.uint64(31)
    return x


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_ALPHABET = mix(np.arange(1, 257, dtype=np.uint64))[_FOLD]  # a random value for each lower-cased byte
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def _powers_of(base: int, n: int) -> np.ndarray:
    factors = np.full(n, base, dtype=np.uint64)
    factors[:1] = 1
    return np.cumprod(factors, dtype=np.uint64)


def _scales(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        _powers[:] = [_powers_of(base, n) for base in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _powers[0][:n], _powers[1][:n]


def separators(*spans: tuple[int, int]) -> np.ndarray:
    """A table of the bytes (after lower-casing A-Z) that separate words."""
    table = np.zeros(256, dtype=bool)
    for low, high in spans:
        table[low : high + 1] = True
    return table[_FOLD]


WHITE_SPACE = separators((0x20, 0x20), (0x09, 0x0D))
#: Everything in ASCII but digits and letters.
PUNCTUATION = separators((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; a null is empty."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def word_hashes(data: np.ndarray, bounds: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words, row after row, and the offsets of the rows in them."""
    hashes, _, _, offsets = word_spans(data, bounds, table)
    return hashes, offsets


def word_spans(data: np.ndarray, bounds: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, first bytes and ends of all words, and the offsets of the rows in them."""
    found = [(np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))]
    total, at = len(data), 0
    edge = np.zeros(total + 1, dtype=bool)
    edge[bounds] = True
    while at < total:
        end = _cut(data, edge, table, at, min(total, at + _WINDOW))
        hashes, starts, ends = _window(data[at:end], edge[at:end], table)
        found.append((hashes, starts + at, ends + at))
        at = end
    hashes, starts, ends = (np.concatenate(x) for x in zip(*found))
    return hashes, starts, ends, np.searchsorted(starts, bounds)


def _cut(data: np.ndarray, edge: np.ndarray, table: np.ndarray, start: int, end: int) -> int:
    """The last place up to ``end`` where no word is cut (or the next one after it, in a word longer than a window)."""
    if end == len(data):
        return end
    for low in range(end - 1, start, -4096):
        back = max(start, low - 4096)
        found = np.flatnonzero(table[data[back : low + 1]] | edge[back + 1 : low + 2])
        if len(found):
            return back + int(found[-1]) + 1
    for high in range(end, len(data), _WINDOW):
        found = np.flatnonzero(table[data[high : high + _WINDOW]] | edge[high:-1][:_WINDOW])
        if len(found):
            return max(start + 1, high + int(found[0]))
    return len(data)


def _window(data: np.ndarray, edge: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inside = ~table[data]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge))
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:] & ~edge[1:]
    ends = np.flatnonzero(inside & ~after) + 1
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), starts, ends
    up, down = _scales(max(len(data), _WINDOW))
    sums = np.empty(len(data) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(_ALPHABET[data] * up[: len(data)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64)), starts, ends


def row_numbers(bounds: np.ndarray) -> np.ndarray:
    """The row of every element, from the offsets of the rows."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def strings(values: list) -> pa.Array:
    return pa.array(values, type=pa.string())
