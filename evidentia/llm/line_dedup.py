"""Exact line deduplication over a corpus; the result is one compressed bitmap per document."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from evidentia.llm.common import fresh, keep, map_batches, prepare, text_frame

_EDGES = b" \t\n\x0b\x0c\r"
_LAST = 2**63 - 1


def line_key(line: bytes) -> bytes:
    """The line without white space at its ends, A-Z lower-cased."""
    return line.strip(_EDGES).lower()


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text, text_key)``: the key tells rows apart that repeat an id with another text."""
    return text_frame(docs, id_col, text_col).withColumn("text_key", F.xxhash64("text"))


def _lines(least: int):
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        high, low, at, rows = [], [], [], []
        for row, text in enumerate(batch.column("text").cast(pa.binary())):
            for position, line in enumerate(text.as_py().split(b"\n")):
                key = line_key(line)
                if len(key) >= least and (len(key) >= 4 * least or len(key.decode()) >= least):
                    digest = xxhash.xxh3_128_intdigest(key)
                    high.append(digest >> 64)
                    low.append(digest & 0xFFFFFFFFFFFFFFFF)
                    at.append(position)
                    rows.append(row)
        row = pa.array(rows, type=pa.int64())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.array(high, dtype=np.uint64).view(np.int64)), pa.array(np.array(low, dtype=np.uint64).view(np.int64)),
                pc.fill_null(batch.column("doc_id").cast(pa.int64()).take(row), _LAST),
                batch.column("text_key").take(row), pa.array(at, type=pa.int32()),
            ],
            names=["high", "low", "doc_id", "text_key", "position"],
        )

    return run


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Later occurrences in rows sorted by hash, document and position.

    ``first`` is the document of the run's first row, known for all runs but a partition's first
    one, which may have begun in the partition before: those rows are ``open``. The last run
    leaves one ``open`` row of its own (position -1), so the next partition can look it up.
    """
    names = ["high", "low", "doc_id", "text_key", "position", "open"]
    run: tuple[int, int] | None = None
    first, leading = 0, True
    for batch in batches:
        high, low, doc = (batch.column(c).to_numpy() for c in ("high", "low", "doc_id"))
        if not len(high):
            continue
        new = np.ones(len(high), dtype=bool)
        new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
        carried = run == (int(high[0]), int(low[0]))
        if run is None:
            run, first = (int(high[0]), int(low[0])), int(doc[0])
        new[0] = not carried
        number = np.cumsum(new) - (0 if carried else 1)
        owners = np.concatenate(([first], doc[new])) if carried else doc[new]
        owner = owners[number]
        head = (high == run[0]) & (low == run[1]) if leading else np.zeros(len(high), dtype=bool)
        out = head | (doc != owner)
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c).filter(pa.array(out)) for c in names[:5]), pa.array(head[out])], names=names
        )
        leading = leading and bool(head[-1])
        run, first = (int(high[-1]), int(low[-1])), int(owner[-1])
    if run is not None:
        yield pa.RecordBatch.from_arrays(
            [pa.array([run[0]]), pa.array([run[1]]), pa.array([first]), pa.array([0]), pa.array([-1], type=pa.int32()), pa.array([True])],
            names=names,
        )


def repeated_lines(docs: DataFrame, least: int = 10) -> DataFrame:
    """``(doc_id, text_key, position)`` of every line that an earlier document holds too.

    ``docs`` comes from ``keyed``. Lines whose key has fewer than ``least`` code points never count.
    The hashes are range-partitioned together with document and position, so the rows of one very
    frequent line spread over as many tasks as they need; what a task cannot know is whether its
    first run began earlier. Those runs, one hash per task at most, are settled by a minimum.
    """
    prepare(docs.sparkSession)
    lines = map_batches(docs, _lines(least), "high long, low long, doc_id long, text_key long, position int")
    order = ["high", "low", "doc_id", "text_key", "position"]
    found = keep(
        lines.repartitionByRange(*order).sortWithinPartitions(*order)
        .mapInArrow(_stream, "high long, low long, doc_id long, text_key long, position int, open boolean"),
        "lines",
    )
    pending = found.filter("open")
    owners = pending.groupBy(F.col("high").alias("_h"), F.col("low").alias("_l")).agg(F.min("doc_id").alias("_first"))
    later = pending.join(
        F.broadcast(owners),  # at most two hashes for each range partition
        (F.col("high") == F.col("_h")) & (F.col("low") == F.col("_l")) & (F.col("doc_id") != F.col("_first")),
    )
    columns = ["doc_id", "text_key", "position"]
    return found.filter("not open").select(*columns).unionByName(later.filter("position >= 0").select(*columns))


def _bitmap(positions: list[int]) -> bytes:
    keep_line = np.ones((max(positions) // 8 + 1) * 8, dtype=bool)  # whole bytes: the padding is kept lines
    keep_line[positions] = False
    return zlib.compress(np.packbits(keep_line).tobytes())


def kept_lines(bitmap: bytes | None, n_lines: int) -> np.ndarray:
    """The decoded bitmap; lines behind its end, and all lines of a null bitmap, are kept."""
    if bitmap is None:
        return np.ones(n_lines, dtype=bool)
    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), dtype=np.uint8)).astype(bool)[:n_lines]
    return np.concatenate((bits, np.ones(n_lines - len(bits), dtype=bool)))


def line_bitmaps(docs: DataFrame, least: int = 10) -> DataFrame:
    """``(doc_id, text_key, bitmap)`` of the documents that lose a line, from ``keyed`` documents.

    A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` with A-Z lower-cased. Keys of at
    least ``least`` code points that two documents hold stay only in the smallest id, there with
    all their lines. Documents are their ids: repeated rows of an id keep the same lines, and null
    ids are one document after all others. Null and empty texts are one empty line. No rows come
    out of an empty table; other columns are not read.
    """

    def pack(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_key"),
             pa.array([_bitmap(x.as_py()) for x in batch.column("positions")], type=pa.binary())],
            names=["doc_id", "text_key", "bitmap"],
        )

    lost = repeated_lines(docs, least).groupBy("doc_id", "text_key").agg(F.collect_set("position").alias("positions"))
    packed = map_batches(lost, pack, "doc_id long, text_key long, bitmap binary")
    return packed.withColumn("doc_id", F.when(F.col("doc_id") != _LAST, F.col("doc_id")))


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``keyed`` documents, with all their columns, beside their bitmap (null: all lines stay)."""
    marks = bitmaps.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "bitmap")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))
    return docs.join(marks, same, "left").drop("_id", "_key")


def cut(text: str, bitmap: bytes | None) -> tuple[str, int, int]:
    """The text without its dropped lines, its number of lines, and how many were dropped."""
    lines = text.split("\n")
    if bitmap is None:
        return text, len(lines), 0
    mask = kept_lines(bitmap, len(lines))
    return "\n".join(line for line, stays in zip(lines, mask) if stays), len(lines), int((~mask).sum())


def deduplicated(docs: DataFrame, least: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all their columns kept, with the texts cut to the lines that stay; a null text stays null."""
    names = docs.columns
    owner, key, marks = (fresh(docs, n) for n in ("_id", "_key", "_bitmap"))
    found = line_bitmaps(keyed(docs, id_col, text_col), least).toDF(owner, key, marks)
    same = F.col(id_col).eqNullSafe(F.col(owner)) & (F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == F.col(key))
    rows = docs.join(found, same, "left").select(*names, marks)

    def shorten(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        at = names.index(text_col)
        texts = [
            t.as_py() if not b.is_valid or not t.is_valid else cut(t.as_py(), b.as_py())[0]
            for t, b in zip(batch.column(at), batch.column(len(names)))
        ]
        columns = [*batch.columns[:at], pa.array(texts, type=pa.string()), *batch.columns[at + 1 : len(names)]]
        yield pa.RecordBatch.from_arrays(columns, names=names)

    return map_batches(rows, shorten, docs.schema)
