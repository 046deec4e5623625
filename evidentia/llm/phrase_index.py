"""A distributed positional inverted index, and exact phrase and proximity matches of benchmark items in it.

The index is cut by documents: each row indexes a block of whole documents, with the sorted
terms of the block and, term after term, their positions. A block answers any phrase by itself:
it takes the lists of the phrase's terms, shifted by their offsets, and intersects them from the
shortest one on. So postings are stored once, never shuffled, and a frequent word or
a passage copied into a third of all documents only lengthens lists inside many blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from evidentia.llm.common import keep, map_batches, prepare, text_frame
from evidentia.llm.words import PUNCTUATION, row_numbers, utf8, word_hashes

_INDEX = "doc_ids array<long>, starts binary, terms binary, counts binary, gaps binary"
_FOUND = "doc_id long, n_words long, n_hit long, items array<string>, near array<string>"
#: Items that travel to the tasks together; more are taken in further slices.
SLICE_ITEMS = 20_000
SLICE_CHARS = 16 << 20


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of whole texts, written to the shared folder; one row for each block of documents.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased, kept as 64-bit hashes.
    Null and empty texts are documents without words. Ids may repeat or be null. Within
    a block all documents share one line of positions, with a hole between neighbours.
    """
    prepare(docs.sparkSession)

    def block(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        words, bounds = word_hashes(*utf8(batch.column("text")), PUNCTUATION)
        places = np.arange(len(words), dtype=np.int64) + row_numbers(bounds)
        order = np.argsort(words, kind="stable")
        ordered, places = words[order], places[order]
        new = np.ones(len(words), dtype=bool)
        new[1:] = ordered[1:] != ordered[:-1]
        firsts = np.flatnonzero(new)
        gaps = np.diff(places, prepend=0)
        gaps[firsts] = places[firsts]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([batch.column("doc_id").to_pylist()], type=pa.list_(pa.int64())),
                *(
                    pa.array([x.tobytes()], type=pa.binary())
                    for x in (
                        bounds, ordered[firsts], np.diff(np.append(firsts, len(words))).astype(np.uint32), gaps.astype(np.uint32),
                    )
                ),
            ],
            names=["doc_ids", "starts", "terms", "counts", "gaps"],
        )

    texts = text_frame(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    # Blocks may be equal; their stored number tells them apart.
    return keep(map_batches(texts, block, _INDEX).withColumn("number", F.monotonically_increasing_id()), "index")


class _Block:
    """One row of the index, opened."""

    def __init__(self, row: dict):
        self.bounds = np.frombuffer(row["starts"], dtype=np.int64)
        self.terms = np.frombuffer(row["terms"], dtype=np.uint64)
        self.counts = np.frombuffer(row["counts"], dtype=np.uint32).astype(np.int64)
        self.gaps = np.frombuffer(row["gaps"], dtype=np.uint32)
        self.firsts = np.concatenate(([0], np.cumsum(self.counts)))
        self.n_docs = len(self.bounds) - 1
        self.starts = self.bounds[:-1] + np.arange(self.n_docs)
        self._lists: dict[int, np.ndarray] = {}

    def places(self, term: int) -> np.ndarray:
        """The sorted positions of the term with this number in the block."""
        if term not in self._lists:
            low = self.firsts[term]
            self._lists[term] = np.cumsum(self.gaps[low : low + self.counts[term]], dtype=np.int64)
        return self._lists[term]

    def documents(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, places, side="right") - 1

    def phrase(self, terms: np.ndarray) -> np.ndarray:
        """Where the terms stand one after the other."""
        rarest = np.argsort(self.counts[terms], kind="stable")
        found = self.places(terms[rarest[0]]) - rarest[0]
        for k in rarest[1:]:
            if not len(found):
                break
            found = _common(found, self.places(terms[k]), k)
        return found

    def nearby(self, terms: np.ndarray, reach: int) -> np.ndarray:
        """Documents where all distinct terms stand within ``reach`` words of an occurrence of the rarest one."""
        distinct = np.unique(terms)
        distinct = distinct[np.argsort(self.counts[distinct], kind="stable")]
        found = self.places(distinct[0])
        of = self.documents(found)
        for term in distinct[1:]:
            if not len(found):
                break
            places = self.places(term)
            after = np.minimum(np.searchsorted(places, found), len(places) - 1)
            close = np.zeros(len(found), dtype=bool)
            for at in (after, np.maximum(after - 1, 0)):
                close |= (np.abs(places[at] - found) <= reach) & (self.documents(places[at]) == of)
            found, of = found[close], of[close]
        return np.unique(of)


def _common(found: np.ndarray, places: np.ndarray, offset: int) -> np.ndarray:
    """The starts that have ``offset`` words later a place of the other list; the shorter list is looked up."""
    if len(places) < len(found):
        wanted = places - offset
        at = np.minimum(np.searchsorted(found, wanted), len(found) - 1)
        return wanted[found[at] == wanted]
    at = np.minimum(np.searchsorted(places, found + offset), len(places) - 1)
    return found[places[at] == found + offset]


class _Windows:
    """The windows of a slice of items: each distinct one once, with the items that have it."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        words, bounds = word_hashes(*utf8(pa.array([text for _, text in items], type=pa.string())), PUNCTUATION)
        self.vocabulary, numbers = np.unique(words, return_inverse=True)
        found: dict[tuple[int, ...], set[int]] = {}
        for item in range(len(items)):
            own = numbers[bounds[item] : bounds[item + 1]].tolist()
            for low in range(max(1, len(own) - window + 1) if own else 0):
                found.setdefault(tuple(own[low : low + window]), set()).add(item)
        self.terms = [np.array(w, dtype=np.int64) for w in found]
        #: All windows as rows, shorter ones padded by a number beyond the vocabulary.
        self.padded = np.full((len(found), window), len(self.vocabulary), dtype=np.int64)
        for k, terms in enumerate(self.terms):
            self.padded[k, : len(terms)] = terms
        self.items = [sorted(x) for x in found.values()]
        self.names = [name for name, _ in items]


def _slices(items: DataFrame) -> Iterator[list[tuple[str, str | None]]]:
    """The items, a bounded slice at a time."""
    held, size = [], 0
    for row in items.toLocalIterator():
        held.append((row["item_id"], row["text"]))
        size += len(row["text"] or "")
        if len(held) >= SLICE_ITEMS or size >= SLICE_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def find_items(
    index: DataFrame, items: DataFrame, window: int = 10, slack: int | None = None, id_col: str = "item_id", text_col: str = "text",
) -> DataFrame:
    """``(doc_id, n_words, n_hit, items, near)`` of every indexed document.

    A window is ``window`` consecutive words of an item; a shorter item, but not one without words,
    is one window. ``items`` are the items (ids as text, sorted) with a window that occurs word for
    word; ``n_hit`` counts the document's words inside an occurrence of any window. With
    ``slack``, ``near`` holds the items with a window all of whose distinct words stand within
    ``window + slack`` words of its rarest one, in any order; without it, ``near`` is null.

    Items with null or repeated ids are kept apart as given; null texts match nothing. Without items
    every document has none. The items visit the blocks in slices of bounded size; a
    document's parts from several slices are merged, words hit twice counting once.
    """
    spark = prepare(index.sparkSession)
    asked = items.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item_id"), F.col(text_col).cast("string").alias("text")
    )
    parts = [_find(index, _Windows(part, window), window, slack) for part in _slices(asked)]
    if len(parts) == 1:
        found = parts[0]
    elif not parts:
        found = _find(index, _Windows([], window), window, slack)
    else:
        found = _merged(parts)
    return found.select(
        "doc_id", "n_words", "n_hit", F.array_sort("items").alias("items"),
        (F.array_sort("near") if slack is not None else F.lit(None).cast("array<string>")).alias("near"),
    )


_PART = "block long, row int, doc_id long, n_words long, n_hit long, items array<string>, near array<string>, hits array<struct<low: long, high: long>>"


def _find(index: DataFrame, windows: _Windows, window: int, slack: int | None) -> DataFrame:
    def search(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for row in batch.to_pylist():
            yield _search(row, windows, window, slack)

    return map_batches(index, search, _PART)


def _search(row: dict, windows: _Windows, window: int, slack: int | None) -> pa.RecordBatch:
    block = _Block(row)
    n = len(block.terms)
    at = np.minimum(np.searchsorted(block.terms, windows.vocabulary), max(0, n - 1))
    known = block.terms[at] == windows.vocabulary if n else np.zeros(len(windows.vocabulary), dtype=bool)
    marks = np.zeros(block.bounds[-1] + block.n_docs + 1, dtype=np.int32)
    items: list[set[str]] = [set() for _ in range(block.n_docs)]
    near: list[set[str]] = [set() for _ in range(block.n_docs)]
    for k in np.flatnonzero(np.append(known, True)[windows.padded].all(axis=1)).tolist():
        terms, owners = windows.terms[k], windows.items[k]
        own, names = at[terms], [windows.names[k] for k in owners]
        places = block.phrase(own)
        if len(places):
            np.add.at(marks, places, 1)
            np.add.at(marks, places + len(terms), -1)
            for d in np.unique(block.documents(places)).tolist():
                items[d].update(names)
        if slack is not None:
            for d in block.nearby(own, window + slack).tolist():
                near[d].update(names)
    inside = np.concatenate(([0], np.cumsum(np.cumsum(marks)[:-1] > 0)))
    lengths = np.diff(block.bounds)
    hit = inside[block.starts + lengths] - inside[block.starts]
    hits = [_runs(marks, low, low + size) if h else [] for low, size, h in zip(block.starts, lengths, hit)]
    listed = pa.list_(pa.string())
    return pa.RecordBatch.from_arrays(
        [
            pa.array([row["number"]] * block.n_docs, type=pa.int64()), pa.array(np.arange(block.n_docs, dtype=np.int32)),
            pa.array(row["doc_ids"], type=pa.int64()), pa.array(lengths), pa.array(hit.astype(np.int64)),
            pa.array([sorted(x) for x in items], type=listed), pa.array([sorted(x) for x in near], type=listed),
            pa.array(hits, type=pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))),
        ],
        names=["block", "row", "doc_id", "n_words", "n_hit", "items", "near", "hits"],
    )


def _runs(marks: np.ndarray, low: int, high: int) -> list[dict]:
    """The spans of words inside an occurrence, counted from the document's first word."""
    inside = np.cumsum(marks[low:high]) > 0  # no occurrence reaches over a document's end
    turns = np.flatnonzero(np.diff(np.concatenate(([0], inside.astype(np.int8), [0]))))
    return [{"low": int(a), "high": int(b)} for a, b in turns.reshape(-1, 2)]


def _merged(parts: list[DataFrame]) -> DataFrame:
    """Documents found in several slices of items: spans united, items put together."""
    parts = [p for p in parts]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    one = union.groupBy("block", "row", "doc_id", "n_words").agg(
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
        F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"),
        F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"),
    )
    covered = F.aggregate(
        "hits", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")),
        lambda s, x: F.struct(
            (s["n"] + F.greatest(F.lit(0), x["high"] - F.greatest(x["low"], s["to"]))).cast("long").alias("n"),
            F.greatest(s["to"], x["high"]).alias("to"),
        ),
        lambda s: s["n"],
    )
    return one.withColumn("n_hit", covered)
