"""Packing by non-negative least squares on the histogram of lengths."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from evidentia.llm.byte_bpe import byte_bpe
from evidentia.llm.common import keep, map_batches, numbered, prepare, text_frame

#: Lengths are counted in classes of so many tokens; a document fills the last step of its class in part.
STEP = 4
#: No fragment is cut that is shorter than this; a gap below it stays padding.
LEAST_CUT = 32


def windows(
    docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens, ids)``: every document's ids and ``end_id``, in windows of the capacity and a rest.

    ``vocabulary`` is the path of the tokenizer's file, read once by the driver. ``ids`` are little-endian
    unsigned 32-bit numbers. Null and empty texts are the end id alone; repeated rows are documents of their own.
    """
    spark = prepare(docs.sparkSession)
    with open(vocabulary, encoding="utf-8") as file:
        spec = spark.sparkContext.broadcast(file.read())
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        tokenizer = byte_bpe(spec.value)
        rows = []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary())):
            ids = tokenizer.ids(text.as_py()) + end
            for low in range(0, len(ids), 4 * capacity):
                part = ids[low : low + 4 * capacity]
                rows.append((doc, low // 4, len(part) // 4, zlib.crc32(part), len(ids) // 4, part))
            if len(ids) > 1 << 22:  # a very long document leaves at once
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)

    texts = text_frame(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return map_batches(texts, cut, _WINDOW)


_WINDOW = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [field.split()[0] for field in _WINDOW.split(", ")]
    kinds = [pa.int64()] * 5 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows), kinds)], names=names)


def combinations(full: int) -> np.ndarray:
    """All ways to fill ``full`` with one, two or three lengths from 1 up, as rows in falling order, padded with 0."""
    first = np.arange(1, full + 1)
    a, b = (x.ravel() for x in np.meshgrid(first, np.arange(full + 1), indexing="ij"))
    c = full - a - b
    return np.stack([a, b, c], axis=1)[(a >= b) & (b >= c) & (c >= 0)]


def repeat_counts(ways: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How often each way is used: the non-negative least squares fit of their lengths to the histogram.

    An active set method: the way that the unmet lengths call for most joins the free ones, these are fitted without
    bounds, and ways that would turn negative leave again. Free ways are never more than there are lengths, so the
    solution is sparse and rounds well. It ends when no way would gain half a document.
    """
    size, target = len(counts), counts.astype(np.float64)
    target[0] = 0
    columns = np.zeros((size, 0))
    free: list[int] = []
    solution = np.zeros(0)
    barred = np.zeros(len(ways), dtype=bool)

    def column(way: int) -> np.ndarray:
        filled = np.bincount(ways[way], minlength=size).astype(np.float64)
        filled[0] = 0
        return filled

    for _ in range(4 * size):
        unmet = target - columns @ solution
        unmet[0] = 0
        gain = unmet[ways].sum(axis=1)
        gain[free] = 0
        gain[barred] = 0
        best = int(gain.argmax())
        if gain[best] <= 0.5:
            break
        free.append(best)
        columns = np.hstack([columns, column(best)[:, None]])
        solution = np.append(solution, 0.0)
        while True:
            fitted = _solve(columns, target)
            if (fitted > 0).all():
                solution = fitted
                break
            falling = fitted <= 0
            ratio = solution[falling] / np.maximum(solution[falling] - fitted[falling], 1e-300)
            solution = solution + ratio.min() * (fitted - solution)
            stay = solution > 1e-9
            if not stay[-1] and free[-1] == best:
                barred[best] = True  # rounding only; it cannot come back and forth
            free = [way for way, s in zip(free, stay) if s]
            columns, solution = columns[:, stay], solution[stay]
            if not free:
                break
    out = np.zeros(len(ways))
    out[free] = solution
    return out


def _solve(columns: np.ndarray, target: np.ndarray) -> np.ndarray:
    products = columns.T @ columns
    try:
        return np.linalg.solve(products, columns.T @ target)
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(columns, target, rcond=None)[0]


@dataclass
class Run:
    """Documents ``first`` to ``first + count - 1`` of a length class, of which steps from ``start`` on are still unpacked."""

    kind: int
    first: int
    count: int
    start: int

    @property
    def left(self) -> int:
        return self.kind - self.start


@dataclass
class Place:
    """Consecutive documents of a class in consecutive sequences: steps ``start`` to ``end`` (0: the rest) at one position."""

    kind: int
    first: int
    count: int
    start: int
    end: int
    sequence: int
    position: int


class _Stock:
    """Runs that are not packed yet, by what is left of them; ``ready`` counts the documents of the last run of each length."""

    def __init__(self, counts: np.ndarray):
        self.runs: dict[int, list[Run]] = {}
        self.ready = np.zeros(len(counts), dtype=np.int64)
        for kind in np.flatnonzero(counts):
            self.put(Run(int(kind), 0, int(counts[kind]), 0))

    def put(self, run: Run) -> None:
        self.runs.setdefault(run.left, []).append(run)
        self.ready[run.left] = run.count

    def take(self, length: int, times: int) -> Run:
        """``times`` documents of the last run of this length."""
        runs = self.runs[length]
        run = runs[-1]
        taken = Run(run.kind, run.first, times, run.start)
        run.first, run.count = run.first + times, run.count - times
        if not run.count:
            runs.pop()
        self.ready[length] = runs[-1].count if runs else 0
        return taken


def plan(counts: np.ndarray, least_cut: int) -> list[Place]:
    """Where the documents of every class go; ``counts[k]`` have a length of ``k`` steps, the last class fills a sequence.

    The rounded repeat counts of the least squares fit are used as far as documents last. The rest is packed greedily:
    the longest document left, then the longest that fits. A gap that no document fits, if it is of ``least_cut``
    steps or more, takes the first steps of the shortest longer one, whose rest goes on as a shorter document. A filling
    is repeated while its runs last, so the work depends on the number of classes, not of documents.
    """
    full = len(counts) - 1
    stock, places, sequence = _Stock(counts), [], 0
    ways = combinations(full)
    used = np.rint(repeat_counts(ways, counts)).astype(np.int64)
    for way in np.argsort(-used, kind="stable"):
        lengths = [int(k) for k in ways[way] if k]
        need = np.bincount(lengths, minlength=full + 1)
        times = min([int(used[way])] + [int(stock.ready[k] // need[k]) for k in set(lengths)])
        if times < 1:
            continue
        for position, length in enumerate(lengths):
            run = stock.take(length, times)
            places.append(Place(run.kind, run.first, times, 0, 0, sequence, position))
        sequence += times
    while stock.ready.any():
        spare, chosen, cut, gap = stock.ready.copy(), [], 0, full
        while gap and len(fits := np.flatnonzero(spare[: gap + 1])):
            chosen.append(int(fits[-1]))
            spare[chosen[-1]] -= 1
            gap -= chosen[-1]
        longer = np.flatnonzero(spare[gap + 1 :])
        if gap >= least_cut and len(longer):
            cut = gap
            chosen.append(int(longer[0]) + gap + 1)
        need = np.bincount(chosen, minlength=full + 1)
        times = int((stock.ready[need > 0] // need[need > 0]).min())
        rests = []
        for position, length in enumerate(chosen):
            run = stock.take(length, times)
            end = run.start + cut if cut and position == len(chosen) - 1 else 0
            places.append(Place(run.kind, run.first, times, run.start, end, sequence, position))
            if end:
                rests.append(Run(run.kind, run.first, times, end))
        for run in rests:
            stock.put(run)
        sequence += times
    return places


class _Finder:
    """The places of the ``k``-th document of a class, searchable by (class, first step, k)."""

    def __init__(self, places: list[Place], full: int):
        self.width = full + 1
        table = np.array([(p.kind, p.start, p.first, p.end, p.sequence, p.position) for p in places], dtype=np.int64).reshape(-1, 6)
        self.key = self._key(table[:, 0], table[:, 1], table[:, 2])
        order = np.argsort(self.key)
        self.key, (self.first, self.end, self.sequence, self.position) = self.key[order], table[order, 2:].T

    def _key(self, kind: np.ndarray, start: np.ndarray, number: np.ndarray) -> np.ndarray:
        return ((kind * self.width + start) << 36) + number

    def pieces(self, kind: np.ndarray, number: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Of all documents their first piece, of the cut ones the second, and so on: rows, first step, end, sequence, position."""
        rows, start = np.arange(len(kind)), np.zeros(len(kind), dtype=np.int64)
        while len(rows):
            at = np.searchsorted(self.key, self._key(kind[rows], start, number[rows]), side="right") - 1
            end = self.end[at]
            yield rows, start, end, self.sequence[at] + number[rows] - self.first[at], self.position[at]
            rows, start = rows[end > 0], end[end > 0]


def pack(cut: DataFrame, capacity: int = 2048, step: int = STEP, least_cut: int = LEAST_CUT, with_ids: bool = False) -> DataFrame:
    """Written ``windows``, each with a ``uid`` of its own, as pieces with ``sequence_id`` and ``offset``.

    Only the histogram, at most ``capacity / step`` counts, meets on the driver. The windows of a class are numbered
    bucket by bucket, so a class that holds a third of all never meets in one task. Ids are read again only
    for cut windows (and for all with ``with_ids``). An empty table gives no rows.
    """
    full = -(-capacity // step)
    cut = cut.withColumn("_kind", F.ceil(F.col("length") / F.lit(step)).cast("long"))
    counts = np.zeros(full + 1, dtype=np.int64)
    for kind, n in cut.groupBy("_kind").agg(F.count(F.lit(1))).collect():
        counts[kind] = n
    places = plan(counts, -(-least_cut // step))
    finder = cut.sparkSession.sparkContext.broadcast(_Finder(places, full))
    buckets = max(1, int(counts.sum() ** 0.5))
    narrow = cut.drop("ids").withColumn("_bucket", F.pmod(F.xxhash64("uid"), F.lit(buckets)))
    ranked = numbered(narrow, ["_kind"], "_bucket", ["uid"], "_number").drop("_bucket")
    carried = ["uid", "doc_id", "start", "ids_crc32", "doc_tokens"]

    def place(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        kind, length = batch.column("_kind").to_numpy(), batch.column("length").to_numpy()
        for rows, low, end, sequence, position in finder.value.pieces(kind, batch.column("_number").to_numpy() - 1):
            low, high = low * step, np.where(end > 0, np.minimum(end * step, length[rows]), length[rows])
            whole = (low == 0) & (high == length[rows])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(pa.array(rows)) for c in carried), *map(pa.array, (low, high - low, whole, sequence, position))],
                names=[*carried, "low", "length", "whole", "sequence_id", "position"],
            )

    placed = map_batches(
        ranked.withColumn("_number", F.col("_number").cast("long")), place,
        ", ".join(f"{c} long" for c in carried) + ", low long, length long, whole boolean, sequence_id long, position long",
    )
    before = Window.partitionBy("sequence_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    placed = keep(placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0).cast("long"))), "placed")
    kinds = sorted({p.kind for p in places if with_ids or p.end})
    texts = cut.filter(F.col("_kind").isin(kinds)).select(F.col("uid").alias("_uid"), "ids")
    again = F.lit(True) if with_ids else ~F.col("whole")
    parts = placed.filter(again).join(texts, F.col("uid") == F.col("_uid")).select(*placed.columns, "ids")

    def share(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        low, length = batch.column("low").to_pylist(), batch.column("length").to_pylist()
        ids = [x.as_py()[4 * a : 4 * (a + n)] for x, a, n in zip(batch.column("ids"), low, length)]
        start = batch.column("start").to_numpy() + batch.column("low").to_numpy()
        columns = [
            batch.column("doc_id"), pa.array(start), batch.column("length"), pa.array([zlib.crc32(x) for x in ids], type=pa.int64()),
            *(batch.column(c) for c in ("doc_tokens", "sequence_id", "offset")),
        ]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(ids, type=pa.binary())], names=[*_PIECE, "ids"])

    found = map_batches(parts, share, ", ".join(f"{c} long" for c in _PIECE) + ", ids binary")
    return found if with_ids else placed.filter("whole").select(*_PIECE).unionByName(found.drop("ids"))


_PIECE = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids])`` of every piece of every document.

    Null and empty texts are the end id alone, repeated rows documents of their own, other columns are not read; an
    empty table gives no rows. Documents above the capacity are cut into windows and a rest; shorter ones only where
    the greedy part fills a gap with them. Equal lengths are interchangeable: rows of a class are taken in the order
    of a hash.
    """
    cut = windows(docs, vocabulary, capacity, end_id).withColumn("uid", F.monotonically_increasing_id())
    return pack(keep(cut, "windows"), capacity, with_ids=with_ids)
