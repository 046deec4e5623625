"""The numbered lines of a whole table as one text that no task has to hold.

Rows are sorted across the cluster and numbered from the sizes of the sorted parts. Their lines travel in pieces of
adjacent ones, at most an Arrow batch each; a digest streams over the pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from evidentia.session import cut_lineage

#: Bits of ``monotonically_increasing_id`` that count the rows of a part; the others number the parts.
_ROW_BITS = 33


def numbered_lines(rows: DataFrame, order: Sequence[str], text: str) -> tuple[DataFrame, int]:
    """``(first, lines)``: the lines "1. text" in ``order``, in pieces, each with the number of its first line; and how many lines there are.

    A row without a text is a line of its number alone. Rows equal in ``order`` must be equal in ``text``.
    """
    # Written down, so that the numbers of the parts and the rows in them stay what they were when they were counted.
    ranked = cut_lineage(
        rows.select(*dict.fromkeys([*order, text])).orderBy(*order).select(F.monotonically_increasing_id().alias("_at"), F.col(text).alias("_text"))
    )
    part = F.shiftright("_at", _ROW_BITS)
    sizes = sorted(tuple(r) for r in ranked.groupBy(part).count().collect())  # one row for each part
    before = list(accumulate((n for _, n in sizes), initial=0))
    starts = rows.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(sizes, before)], "_part long, _before long")
    number = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)) + 1
    lines = ranked.withColumn("_part", part).join(F.broadcast(starts), "_part").select(
        number.alias("first"), F.concat_ws(". ", number.cast("string"), "_text").cast("binary").alias("lines")
    )
    return lines.mapInArrow(_pieces, "first long, lines binary"), before[-1]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        first, lines = batch.column("first").to_numpy(), batch.column("lines").to_pylist()
        if not lines:
            continue
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(first) != 1) + 1))
        texts = [b"\n".join(lines[a:b]) for a, b in zip(cuts, [*cuts[1:], len(lines)])]
        yield pa.RecordBatch.from_arrays([pa.array(first[cuts]), pa.array(texts, type=pa.binary())], names=["first", "lines"])


def whole_text(pieces: DataFrame) -> DataFrame:
    """``(text)``: the pieces as one text, in one row."""
    parts = F.transform("all", lambda p: p["lines"].cast("string"))
    return pieces.agg(F.array_sort(F.collect_list(F.struct("first", "lines"))).alias("all")).select(F.array_join(parts, "\n").alias("text"))


def text_digest(pieces: DataFrame, algorithm: str) -> DataFrame:
    """``(text)``: the hexadecimal digest of the whole text, one stream by definition; there must be a piece."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, between = hashlib.new(algorithm), b""
        for batch in batches:
            for lines in batch.column("lines"):
                state.update(between)
                state.update(lines.as_buffer())
                between = b"\n"
        yield pa.RecordBatch.from_arrays([pa.array([state.hexdigest()])], names=["text"])

    return pieces.repartition(1).sortWithinPartitions("first").mapInArrow(digest, "text string")
