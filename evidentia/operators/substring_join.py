"""Join texts to the phrases that occur inside them, without a nested loop.

Few phrases travel to the texts as one automaton, which finds all of them in one pass over each text.
Many phrases are met by an equi-join: each is filed under its beginning (its anchor), the longest one
whose length is a power of two, each text under all its substrings of the anchors' widths. Both sides meet on
a hash of the anchor, as numbers of rows, and only those pairs are verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructType

from evidentia.functions.text import substrings
from evidentia.session import cut_lineage, holds_at_most

#: The longest anchor.
_WIDEST = 64
#: Phrases, with the columns they carry, are broadcast up to this size.
_MAX_BYTES = 64 << 20
#: Texts up to this number and size are broadcast as anchors, a few for each of their characters.
_FEW_TEXTS, _FEW_BYTES = 10_000, 1 << 20


def substring_join(
    texts: DataFrame, text: str, phrases: DataFrame, phrase: str, salts: int = 8,
    max_broadcast_rows: int = 50_000, key: str | None = None,
) -> DataFrame:
    """All columns of both sides for each (text, phrase) with the phrase inside the text.

    An empty phrase occurs in every text. Phrases proven few are broadcast. Else a
    frequent anchor cannot pile up in one task: texts are spread over ``salts`` and
    the phrases, the short side, are repeated for each salt. With ``key`` the only column of the texts that
    the result has is this one, and only it leaves the tasks that look for the phrases.
    """
    known = phrases.where(F.col(phrase).isNotNull())
    if holds_at_most(known, max_broadcast_rows, _MAX_BYTES):
        return _found(texts, text, known, phrase, texts.columns if key is None else [key])
    met = _met(texts, text, known, phrase, salts)
    return met if key is None else met.select(key, *phrases.columns)


def _found(texts: DataFrame, text: str, phrases: DataFrame, phrase: str, kept: list[str]) -> DataFrame:
    """By one automaton of all phrases in each task."""
    spark = texts.sparkSession
    wanted = [r[0] for r in phrases.select(phrase).distinct().collect()]
    shared = spark.sparkContext.broadcast(wanted)
    place = kept.index(text) if text in kept else len(kept)
    carried = texts.where(F.col(text).isNotNull()).select(*kept, *([text] if text not in kept else []))
    schema = StructType(texts.select(*kept).schema.fields).add("_phrase", LongType())

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, always = ahocorasick.Automaton(), []
        for number, words in enumerate(shared.value):
            if words:
                finder.add_word(words, number)
            else:
                always.append(number)
        some = len(finder) > 0
        finder.make_automaton()
        for batch in batches:
            rows, found = [], []
            for row, value in enumerate(batch.column(place).to_pylist()):
                hits = {number for _, number in finder.iter(value)} if some else set()
                hits.update(always)
                rows.extend([row] * len(hits))
                found.extend(hits)
                if len(rows) >= 100_000:
                    yield hit_rows(batch, rows, found)
                    rows, found = [], []
            yield hit_rows(batch, rows, found)

    def hit_rows(batch: pa.RecordBatch, rows: list[int], found: list[int]) -> pa.RecordBatch:
        at = pa.array(rows, type=pa.int64())
        return pa.RecordBatch.from_arrays([*(batch.column(n).take(at) for n in range(len(kept))), pa.array(found, type=pa.int64())], names=schema.fieldNames())

    numbers = spark.createDataFrame([(n, words) for n, words in enumerate(wanted)], "_phrase long, _words string")
    numbered = phrases.join(F.broadcast(numbers), F.col(phrase) == F.col("_words")).drop("_words")
    return carried.mapInArrow(find, schema).join(F.broadcast(numbered), "_phrase").drop("_phrase")


def _met(texts: DataFrame, text: str, phrases: DataFrame, phrase: str, salts: int) -> DataFrame:
    """By an equi-join on anchors; rows are numbered, so that only numbers and hashes meet."""
    left = cut_lineage(texts.where(F.col(text).isNotNull()).withColumn("_t", F.monotonically_increasing_id()))
    right = cut_lineage(phrases.withColumn("_p", F.monotonically_increasing_id()))
    width = _width(F.col(phrase))
    widths = sorted(r[0] for r in right.select(width).distinct().collect())  # at most one for each power of two
    few = holds_at_most(left.select(text), _FEW_TEXTS, _FEW_BYTES)
    salt = F.lit(0) if few else F.pmod("_t", F.lit(salts)).cast("int")
    pieces = [F.array(F.lit("")) if w == 0 else substrings(F.col(text), w) for w in widths] or [F.array().cast("array<string>")]
    hashes = F.transform(F.concat(*pieces), lambda piece: F.xxhash64(piece, salt))
    narrow = left.select("_t", F.explode(F.array_distinct(hashes)).alias("_anchor"))
    copies = F.array(F.lit(0)) if few else F.sequence(F.lit(0), F.lit(salts - 1))
    begun = right.select("_p", F.left(F.col(phrase), width).alias("_piece"), F.explode(copies).alias("_salt"))
    begun = begun.select("_p", F.xxhash64("_piece", "_salt").alias("_anchor"))
    pairs = (F.broadcast(narrow) if few else narrow).join(begun, "_anchor").select("_t", "_p")
    return pairs.join(left, "_t").join(right, "_p").where(F.contains(F.col(text), F.col(phrase))).drop("_t", "_p")


def _width(c: Column) -> Column:
    """The greatest power of two that is not longer than the text, up to ``_WIDEST``; 0 for the empty text."""
    width = F.lit(0)
    w = 1
    while w <= _WIDEST:
        width = F.when(F.length(c) >= w, w).otherwise(width)
        w *= 2
    return width
