"""Streams that maintain tables: deduplication, latest-wins upserts, incremental ingest."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from evidentia.operators.conversations import apply_facts, merge_facts, message_facts
from evidentia.operators.skew import latest
from evidentia.plans.ingest import run_ingest
from evidentia.sources import tables


def stream_dedupe(
    messages: DataFrame, delay: str = "1 hour", keys: Sequence[str] = ("conversation_id", "client_message_id"),
    time: str = "created_at",
) -> DataFrame:
    """Drops repeated submissions; exact while repeats arrive within ``delay``. Null ids pass."""
    named = messages.where(F.col(keys[-1]).isNotNull())
    unnamed = messages.where(F.col(keys[-1]).isNull())
    unique = named.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))
    return unique.union(unnamed)


def stream_upsert(
    stream: DataFrame, root: str, keys: Sequence[str], order: Sequence[str], checkpoint: str
) -> StreamingQuery:
    """Keeps the latest row per key under ``root``.

    A micro-batch is reduced to one row per key and written to a folder of its own,
    named by its number: cheap, and written again with the same result if the batch
    is repeated. Stored rows are not rewritten; :func:`read_latest` merges, and
    :func:`compact` folds the batches into a base when it suits.
    """

    def write(batch: DataFrame, number: int) -> None:
        latest(batch, keys, order).write.mode("overwrite").parquet(f"{root}/delta/batch={number}")

    return (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def read_latest(spark: SparkSession, root: str, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return _merged(spark, root, lambda rows: latest(rows, keys, order))


def compact(spark: SparkSession, root: str, keys: Sequence[str], order: Sequence[str]) -> None:
    """Folds everything written so far into a new base version."""
    _compact(spark, root, lambda rows: latest(rows, keys, order))


def stream_rollup(messages: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Keeps the facts of every conversation's messages (count, last time, earliest user message) under ``root``.

    A micro-batch is reduced to one row per conversation in it and written to a folder of its own, named by its number,
    so a repeated batch changes nothing. Facts add up in any order: messages may be late by any time, and no
    state is held. :func:`read_rollup` gives the conversations, :func:`compact_rollup` folds the batches.
    """

    def write(batch: DataFrame, number: int) -> None:
        message_facts(batch).write.mode("overwrite").parquet(f"{root}/delta/batch={number}")

    return (
        messages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def read_rollup(spark: SparkSession, root: str, conversations: DataFrame) -> DataFrame:
    """``conversations`` rolled up by all messages that have arrived."""
    return apply_facts(conversations, _merged(spark, root, merge_facts))


def compact_rollup(spark: SparkSession, root: str) -> None:
    _compact(spark, root, merge_facts)


def _compact(spark: SparkSession, root: str, merge: Callable[[DataFrame], DataFrame]) -> None:
    version = tables.current_version(spark, root)
    newest = spark.read.parquet(f"{root}/delta").agg(F.coalesce(F.max("batch"), F.lit(-1)).cast("long").alias("batch"))
    through = newest.first()["batch"]
    mark = spark.range(1).select(F.lit(through).alias("batch"))
    tables.save_snapshot(spark, root, {"base": _merged(spark, root, merge, through), "through": mark}, version + 1)


def _merged(spark: SparkSession, root: str, merge: Callable[[DataFrame], DataFrame], through: int | None = None) -> DataFrame:
    """The base, and the micro-batches after it (up to ``through``); the others are not opened."""
    version = tables.current_version(spark, root)
    rows = spark.read.parquet(f"{root}/delta")
    if through is not None:
        rows = rows.where(F.col("batch") <= through)
    if version:
        done = tables.load_snapshot(spark, root, "through", version).first()["batch"]
        rows = rows.where(F.col("batch") > done).drop("batch").unionByName(tables.load_snapshot(spark, root, "base", version))
        return merge(rows)
    return merge(rows.drop("batch"))


def stream_ingest(files: DataFrame, entities: DataFrame, target: str, checkpoint: str, **options) -> StreamingQuery:
    """Runs the ingest job on new and changed files; other documents stay as they are."""

    def write(batch: DataFrame, number: int) -> None:
        # Files of a repeated batch are unchanged against the snapshot, so the repeat adds nothing.
        run_ingest(batch, entities, target, partial=True, **options)

    return (
        files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
