"""Best-two-fit packing of tokenized documents into sequences of a fixed length."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from evidentia.llm.common import keep, map_batches, numbered, prepare, text_frame
from evidentia.llm.word_bpe import word_bpe


def pieces(
    docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False, id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32[, ids])``: every document's ids and ``end_id``, cut only where they exceed the capacity.

    ``vocabulary`` is the path of the tokenizer's file, read once by the driver. Null and empty texts
    are the end id alone. Repeated rows are documents of their own.
    """
    spark = prepare(docs.sparkSession)
    with open(vocabulary, encoding="utf-8") as file:
        spec = spark.sparkContext.broadcast(file.read())
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        tokenizer = word_bpe(spec.value)
        row, piece, start, length, crc, held = [], [], [], [], [], []
        for k, text in enumerate(batch.column("text").cast(pa.binary())):
            ids = tokenizer.ids(text.as_py()) + end
            for n, low in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[low : low + 4 * capacity]
                row.append(k)
                piece.append(n)
                start.append(low // 4)
                length.append(len(part) // 4)
                crc.append(zlib.crc32(part))
                if with_ids:
                    held.append(part)
        columns = [
            batch.column("doc_id").take(pa.array(row, type=pa.int64())), pa.array(piece, type=pa.int32()),
            *(pa.array(x, type=pa.int64()) for x in (start, length, crc)),
        ]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        if with_ids:
            columns, names = [*columns, pa.array(held, type=pa.binary())], [*names, "ids"]
        yield pa.RecordBatch.from_arrays(columns, names=names)

    texts = text_frame(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return map_batches(texts, cut, schema)


@dataclass
class Bins:
    """Bins of one filling: the lengths in it, in order, and how often it is used."""

    lengths: list[int]
    times: int


def two_fit(counts: np.ndarray, capacity: int) -> list[Bins]:
    """Fill bins from a histogram of lengths (``counts[n]`` documents of length ``n``).

    A bin takes the longest document left, then again and again the longest that fits. If it
    is not full, its smallest document gives way to the two unpacked ones that fill its
    expanded gap most tightly, if they fill more of it than it did. Documents of equal length
    are interchangeable, so a filling is used as often as its lengths last: the work depends
    on the capacity, not on the number of documents.
    """
    left = counts.astype(np.int64).copy()
    fillings = []
    while left.any():
        bin_, gap = [], capacity
        while gap:
            fitting = np.flatnonzero(left[: gap + 1])
            if not len(fitting):
                break
            length = int(fitting[-1])
            bin_.append(length)
            left[length] -= 1
            gap -= length
        if gap and len(bin_) > 1:
            pair = _two(left, gap + bin_[-1], bin_[-1])
            if pair:
                left[bin_.pop()] += 1
                for length in pair:
                    bin_.append(length)
                    left[length] -= 1
        used = np.bincount(bin_, minlength=len(left))
        more = int((left[used > 0] // used[used > 0]).min())
        left -= more * used
        fillings.append(Bins(bin_, 1 + more))
    return fillings


def _two(left: np.ndarray, room: int, least: int) -> tuple[int, int] | None:
    """The two lengths left whose sum is the largest up to ``room``, if it is more than ``least``."""
    have = np.flatnonzero(left)
    have = have[(have > 0) & (have < room)]
    if not len(have):
        return None
    at = np.searchsorted(have, room - have, side="right") - 1
    partner = np.where(at >= 0, have[np.maximum(at, 0)], 0)
    twice = (partner == have) & (left[have] < 2)
    lower = np.where(at >= 1, have[np.maximum(at - 1, 0)], 0)
    partner = np.where(twice, lower, partner)
    total = np.where(partner > 0, have + partner, 0)
    best = int(total.argmax())
    if total[best] <= least:
        return None
    return max(int(have[best]), int(partner[best])), min(int(have[best]), int(partner[best]))


class _Slots:
    """Where the ``k``-th document of a length stands: places in order, searchable by (length, k)."""

    def __init__(self, fillings: list[Bins], capacity: int):
        low = np.zeros(capacity + 1, dtype=np.int64)
        rows = []
        sequence = 0
        for filling in fillings:
            offset = 0
            for length in filling.lengths:
                rows.append((length, low[length], sequence, offset))
                low[length] += filling.times
                offset += length
            sequence += filling.times
        table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)
        self.first = np.searchsorted(table[:, 0], np.arange(capacity + 2))
        self.low, self.sequence, self.offset = table[:, 1].copy(), table[:, 2].copy(), table[:, 3].copy()
        self.key = table[:, 0] * (1 << 40) + self.low

    def find(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, length * (1 << 40) + number, side="right") - 1
        return self.sequence[at] + number - self.low[at], self.offset[at]


def pack(cut: DataFrame, capacity: int = 2048) -> DataFrame:
    """``cut`` (rows with ``doc_id``, ``piece``, ``length``, ``ids_crc32``) and its ``sequence_id`` and ``offset``.

    Only the histogram of lengths, at most ``capacity`` counts, meets on the driver. The rows of a length
    are numbered bucket by bucket, so one very frequent length never meets in one task, and each
    number has its place in the fillings. Lengths of 0 are not allowed; an empty table gives no rows.
    """
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in cut.groupBy("length").agg(F.count(F.lit(1))).collect():
        counts[length] = n
    slots = _Slots(two_fit(counts, capacity), capacity)
    buckets = max(1, int(counts.sum() ** 0.5))
    spread = cut.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    ranked = numbered(spread, ["length"], "_bucket", ["doc_id", "piece", "ids_crc32"], "_number").drop("_bucket")

    def place(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        length, number = batch.column("length").to_numpy(), batch.column("_number").to_numpy() - 1
        sequence, offset = slots.find(length, number)
        rest = [c for c in batch.schema.names if c != "_number"]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in rest), pa.array(sequence), pa.array(offset)], names=[*rest, "sequence_id", "offset"]
        )

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields]
    ranked = ranked.withColumn("_number", F.col("_number").cast("long"))
    return map_batches(ranked, place, ", ".join([*fields, "sequence_id long", "offset long"]))


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    return pack(keep(pieces(docs, vocabulary, capacity, end_id, with_ids), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """``(sequence_id, length, ids)`` from pieces packed with their ids: the training sequences themselves."""
    parts = packed.groupBy("sequence_id").agg(
        F.sum("length").alias("length"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts")
    )

    def join(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        joined = [b"".join(p["ids"] for p in row) for row in batch.column("parts").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("sequence_id"), batch.column("length"), pa.array(joined, type=pa.binary())], names=["sequence_id", "length", "ids"]
        )

    return map_batches(parts, join, "sequence_id long, length long, ids binary")
