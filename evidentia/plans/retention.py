"""The nightly retention job over a bucketed store of conversation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from evidentia.operators.conversations import expired_conversations, expired_visitors
from evidentia.session import cut_lineage
from evidentia.sources import bucketed
from evidentia.sources.bucketed import Change

#: The tables of a store and the column their rows are changed by; a conversation's messages come and go together.
OWNERS = {"visitors": "visitor_id", "conversations": "conversation_id", "messages": "conversation_id", "feedback": "message_id"}


def create_store(spark: SparkSession, root: str, tables: dict[str, DataFrame], buckets: int = bucketed.BUCKETS) -> int:
    """A new store that holds the given tables; returns its version."""
    bucketed.create(spark, root, {name: (OWNERS[name], df.schema) for name, df in tables.items()}, buckets)
    return bucketed.commit(spark, root, {name: Change(df) for name, df in tables.items()})


def retention_job(spark: SparkSession, root: str, as_of, days: int) -> DataFrame:
    """Removes what is too old from the store at ``root`` as one version; one row of counts.

    Conversations without activity for ``days`` days go, visitors that expired or were revoked go, and with them
    their conversations, the messages of these and the feedback on those. ``removed`` counts only the conversations that
    were too old themselves. Below the first level only the buckets of what goes are opened, and of messages and
    feedback only the ids; written are the ids that go and the buckets that have lost too large a share. A run that
    finds nothing writes no version; a run that dies leaves the store as it was.
    """
    conversations = bucketed.read(spark, root, "conversations")
    visitors = cut_lineage(expired_visitors(bucketed.read(spark, root, "visitors"), as_of).select("visitor_id").distinct())
    old = expired_conversations(conversations, as_of, days).select("conversation_id", F.lit(1).alias("old"))
    left = conversations.join(visitors, "visitor_id", "left_semi").select("conversation_id", F.lit(0).alias("old"))
    gone = cut_lineage(old.unionByName(left).groupBy("conversation_id").agg(F.max("old").alias("old")))
    messages = cut_lineage(_held(spark, root, "messages", gone, ["conversation_id", "message_id"]))
    feedback = cut_lineage(_held(spark, root, "feedback", messages.select("message_id").distinct(), ["message_id"]))
    owners = {"visitors": visitors, "conversations": gone, "messages": messages, "feedback": feedback}
    counts = {"removed": gone.where("old = 1").count(), **{name: df.count() for name, df in owners.items()}}
    if any(counts.values()):
        bucketed.commit(spark, root, {name: Change(owners=df.select(OWNERS[name]).distinct()) for name, df in owners.items()})
    return spark.createDataFrame([tuple(counts.values())], ", ".join(f"{name} long" for name in counts))


def _held(spark: SparkSession, root: str, table: str, owners: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of the rows that these owners have, from their buckets alone."""
    rows = bucketed.read(spark, root, table, buckets=bucketed.buckets_of(spark, root, table, owners))
    return rows.select(*columns).join(owners.select(OWNERS[table]), OWNERS[table], "left_semi")
