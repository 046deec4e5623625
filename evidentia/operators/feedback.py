"""Feedback on answers: checks, latest-wins upsert, removal of duplicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from evidentia import fixed_values as fixed
from evidentia.operators.skew import latest


def check_feedback(
    feedback: DataFrame, reasons: Sequence[str] = fixed.FEEDBACK_REASONS, max_comment: int = 500
) -> DataFrame:
    """Adds ``rating_ok, reason_ok, comment_ok, valid``."""
    return (
        feedback.withColumn("rating_ok", F.coalesce(F.col("rating").isin(-1, 1), F.lit(False)))
        .withColumn("reason_ok", F.col("reason").isNull() | F.col("reason").isin(*reasons))
        .withColumn("comment_ok", F.coalesce(F.length("comment") <= max_comment, F.lit(True)))
        .withColumn("valid", F.col("rating_ok") & F.col("reason_ok") & F.col("comment_ok"))
    )


def upsert_feedback(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """One row per message: the stored row keeps its identity, the latest values win.

    ``incoming`` may hold many rows for a message; they are reduced before any
    shuffle.
    """
    values = ["rating", "reason", "comment"]
    newest = latest(incoming, ["message_id"], ["created_at", "feedback_id"])
    first = incoming.groupBy("message_id").agg(
        F.min_by("feedback_id", F.struct("created_at", "feedback_id")).alias("_first_id"),
        F.min("created_at").alias("_first_at"),
    )
    fresh = newest.join(first, "message_id").select(
        "message_id", "_first_id", "_first_at", F.struct(*values).alias("_new")
    )
    joined = stored.withColumn("_old", F.struct(*values)).join(fresh, "message_id", "full")
    return joined.select(
        F.coalesce("feedback_id", "_first_id").alias("feedback_id"),
        "message_id",
        *[F.when(F.col("_new").isNotNull(), F.col(f"_new.{v}")).otherwise(F.col(f"_old.{v}")).alias(v) for v in values],
        F.coalesce("created_at", "_first_at").alias("created_at"),
    )


def dedupe_feedback(feedback: DataFrame) -> DataFrame:
    """Newest row per message by (created_at, id); rows without a message stay as they are."""
    about = feedback.where(F.col("message_id").isNotNull())
    return latest(about, ["message_id"], ["created_at", "feedback_id"]).unionByName(
        feedback.where(F.col("message_id").isNull())
    )
