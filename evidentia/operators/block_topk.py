"""Exact top-k of a distributed corpus for a whole table of questions.

Rows of both sides travel in blocks (one Arrow payload per block). A task scores
a corpus block against a question block with one matrix product and keeps only
the best k per question over everything it has seen, so what it emits does not
grow with the corpus. A window over these partial lists gives the exact result.

The corpus is never shuffled: questions are broadcast, in slices of a bounded
number of rows, and every slice is one scan of the corpus where it lies.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

ScoreBlock = Callable[[pa.Table, pa.Table], np.ndarray]

# (target, pass) lists kept by a task before it hands them on and starts afresh.
_MAX_LISTS = 200_000


def topk_by_block(
    corpus: DataFrame,
    targets: DataFrame,
    score: ScoreBlock,
    *,
    corpus_key: str = "chunk_id",
    target_key: str = "target_id",
    k: str = "fetch_k",
    max_k: int,
    score_name: str,
    mask: Callable[[pa.Table, pa.Table, int], np.ndarray | None] | None = None,
    passes: tuple[int, ...] = (1,),
    max_broadcast_rows: int = 20_000,
    rows_per_block: int = 2048,
    targets_per_block: int = 512,
) -> DataFrame:
    """``(target_key, pass_no, corpus_key, score_name, rank)``, best ``k`` rows per list.

    ``score`` returns a corpus-by-question matrix, NaN where there is no match;
    ties go to the smaller ``corpus_key``. ``mask`` gives the rows a pass may use,
    or None where the pass does not apply. ``k`` is a column of ``targets``; a value above
    ``max_k`` is an error when the result is computed.
    """
    key_type = corpus.schema[corpus_key].dataType.simpleString()
    target_type = targets.schema[target_key].dataType.simpleString()
    # Slices by hash may differ in size; half the bound on average leaves room for that.
    rows = targets.count()
    slices = 1 if rows <= max_broadcast_rows else -(-2 * rows // max_broadcast_rows)
    number = F.pmod(F.xxhash64(target_key), F.lit(slices))
    corpus_blocks = _pack(corpus, rows_per_block, "corpus_block")

    def scan(part: DataFrame) -> DataFrame:
        blocks = _pack(part, targets_per_block, "target_block").withColumn("target_block_id", F.sha2("target_block", 256))
        # Every corpus block meets the few blocks of the slice: one row with all of them.
        return corpus_blocks.join(F.broadcast(blocks), "scan")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple[str, int], _Best] = {}
        decoded: dict[str, pa.Table] = {}
        corpus_bytes, block = None, None
        for batch in batches:
            rows = zip(
                batch.column("corpus_block"),
                batch.column("target_block"),
                batch.column("target_block_id").to_pylist(),
            )
            for corpus_payload, target_payload, block_id in rows:
                payload = corpus_payload.as_buffer()
                if corpus_bytes is None or not payload.equals(corpus_bytes):
                    corpus_bytes, block = payload, _read(payload).sort_by(corpus_key)
                if block_id not in decoded:
                    decoded[block_id] = _read(target_payload.as_buffer())
                questions = decoded[block_id]
                scores = score(block, questions)
                ids = block.column(corpus_key).to_numpy()
                for number in passes:
                    allowed = mask(block, questions, number) if mask else True
                    if allowed is None:
                        continue
                    lists = kept.setdefault((block_id, number), _Best(max_k, len(questions)))
                    lists.add(np.where(allowed, scores, np.nan), ids)
            if sum(b.width for b in kept.values()) > _MAX_LISTS:
                yield from _emit(kept, decoded)
                kept, decoded = {}, {}
        yield from _emit(kept, decoded)

    def _emit(kept, decoded):
        for (block_id, number), lists in kept.items():
            names = decoded[block_id].column(target_key)
            column, ids, scores = lists.rows()
            if len(ids):
                yield pa.RecordBatch.from_arrays(
                    [
                        names.take(pa.array(column)).combine_chunks(),
                        pa.array(np.full(len(ids), number, dtype="int32")),
                        pa.array(ids),
                        pa.array(scores),
                    ],
                    names=[target_key, "pass_no", corpus_key, score_name],
                )

    schema = f"{target_key} {target_type}, pass_no int, {corpus_key} {key_type}, {score_name} double"
    partial = scan(targets.where(number == 0)).mapInArrow(best, schema)
    for k_slice in range(1, slices):
        partial = partial.unionByName(scan(targets.where(number == k_slice)).mapInArrow(best, schema))
    order = W.partitionBy(target_key, "pass_no").orderBy(F.desc(score_name), corpus_key)
    ranked = partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max_k)
    quota = F.when(F.col(k) > max_k, F.raise_error(F.lit(f"{k} asks for more rows than max_k allows")).cast("long")).otherwise(F.col(k))
    return ranked.join(targets.select(target_key, quota.alias("_k")), target_key).where(
        F.col("rank") <= F.col("_k")
    ).drop("_k")


class _Best:
    """The best ``k`` corpus rows per question of one block."""

    def __init__(self, k: int, width: int):
        self.k, self.width = k, width
        self.scores = np.full((0, width), np.nan)
        self.ids = None

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        # Corpus keys are sorted, so a stable sort already settles ties.
        best = np.argsort(-scores, axis=0, kind="stable")[: self.k]
        new_scores, new_ids = np.take_along_axis(scores, best, axis=0), ids[best]
        if self.ids is not None:
            new_scores = np.concatenate([self.scores, new_scores])
            new_ids = np.concatenate([self.ids, new_ids])
            best = np.lexsort((new_ids, -new_scores), axis=0)[: self.k]
            new_scores = np.take_along_axis(new_scores, best, axis=0)
            new_ids = np.take_along_axis(new_ids, best, axis=0)
        self.scores, self.ids = new_scores, new_ids

    def rows(self):
        if self.ids is None:
            return np.array([], dtype="int64"), np.array([]), np.array([])
        found = ~np.isnan(self.scores)
        column = np.broadcast_to(np.arange(self.width), self.scores.shape)[found]
        return column, self.ids[found], self.scores[found]


def _pack(df: DataFrame, rows: int, name: str) -> DataFrame:
    """One row per block: its rows as one Arrow stream. ``scan`` is the same for all, the key by which blocks meet."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for start in range(0, len(table), rows):
                sink = pa.BufferOutputStream()
                piece = table.slice(start, rows).combine_chunks()
                with pa.ipc.new_stream(sink, piece.schema) as writer:
                    writer.write_table(piece)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([0], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["scan", name]
                )

    return df.mapInArrow(pack, f"scan int, {name} binary")


def _read(payload: pa.Buffer) -> pa.Table:
    return pa.ipc.open_stream(payload).read_all()
