"""Conversation history, memory and retention.

Conversations: ``conversation_id, visitor_id, title, created_at, last_active_at,
last_message_at, deleted_at, summary, summarized_through_sequence, …``.
Messages: ``message_id, conversation_id, sequence_no, role, content, status,
client_message_id, created_at, …``.

Newest-n lists use ``row_number() <= n``, which Spark cuts per task before the
shuffle, so a conversation with very many messages does not gather in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from evidentia import fixed_values as fixed
from evidentia.functions.text import display_text, estimate_tokens_ws, strip, summary_line
from evidentia.operators.skew import latest, number_rows, salted_join
from evidentia.session import broadcast_if_small


def _newest_first() -> list[Column]:
    return [F.desc_nulls_last("last_message_at"), F.desc("created_at"), F.asc("conversation_id")]


def _latest_message(messages: DataFrame) -> DataFrame:
    return messages.groupBy("conversation_id").agg(F.max_by("content", "sequence_no").alias("last_message"))


def list_owned(conversations: DataFrame, messages: DataFrame, limit: int = 30, preview: int = 80) -> DataFrame:
    """Per visitor, the newest conversations that are not deleted, with a preview."""
    order = W.partitionBy("visitor_id").orderBy(*_newest_first())
    newest = (
        active(conversations).where(F.col("visitor_id").isNotNull())
        .withColumn("position", F.row_number().over(order))
        .where(F.col("position") <= limit)
    )
    # Only messages of conversations on the list are aggregated.
    wanted = broadcast_if_small(newest.select("conversation_id"), 1_000_000)
    latest_of = _latest_message(messages.join(wanted, "conversation_id", "left_semi"))
    return newest.join(latest_of, "conversation_id", "left").select(
        "visitor_id", "position", "conversation_id",
        F.when(F.coalesce("title", F.lit("")) == "", fixed.DEFAULT_TITLE).otherwise(F.col("title")).alias("title"),
        F.when(F.col("last_message") != "", F.substring("last_message", 1, preview)).alias("last_message_preview"),
        F.coalesce("last_message_at", "last_active_at", "created_at").alias("updated_at"),
    )


def list_admin(
    conversations: DataFrame, messages: DataFrame, search: str = "", limit: int = 100
) -> DataFrame:
    """The newest conversations of all visitors with first question and latest message."""
    shown = search_conversations(conversations, messages, search) if search else conversations
    top = shown.orderBy(*_newest_first()).limit(limit)
    ids = top.select("conversation_id")
    wanted = F.broadcast(ids) if limit <= 100_000 else ids
    ends = messages.join(wanted, "conversation_id", "left_semi").groupBy("conversation_id").agg(
        F.expr("min_by(content, sequence_no) FILTER (WHERE role = 'user')").alias("first_question"),
        F.max_by("content", "sequence_no").alias("last_message_preview"),
    )
    return top.join(ends, "conversation_id", "left").withColumn(
        "shown_question", display_text(F.coalesce("first_question", "title"))
    )


def search_conversations(conversations: DataFrame, messages: DataFrame, text: str) -> DataFrame:
    """Title or any message contains ``text`` (case-insensitive; ``_`` and ``%`` are wildcards)."""
    pattern = f"%{text}%"
    hits = (
        messages.where(F.col("content").ilike(pattern)).select("conversation_id").distinct()
        .withColumn("_hit", F.lit(True))
    )
    return (
        conversations.join(hits, "conversation_id", "left")
        .where(F.coalesce(F.col("title").ilike(pattern), F.lit(False)) | F.col("_hit").isNotNull())
        .drop("_hit")
    )


def activity_totals(
    conversations: DataFrame, visitors: DataFrame, messages: DataFrame, feedback: DataFrame
) -> DataFrame:
    """One row of table counts, from one aggregate per table."""
    tables = {"conversations": conversations, "visitors": visitors, "messages": messages, "feedback": feedback}
    counted = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).withColumn("name", F.lit(name))
        counted = one if counted is None else counted.unionByName(one)
    return counted.groupBy().agg(
        *[F.coalesce(F.sum(F.when(F.col("name") == n, F.col("n"))), F.lit(0)).alias(n) for n in tables]
    )


def message_page(
    messages: DataFrame, n: int = 30, before: int | None = None, completed_only: bool = False
) -> DataFrame:
    """Per conversation, its newest ``n`` messages (1 to 50) before a sequence number.

    ``has_more`` looks one message further. Roles other than user and assistant
    take part in the paging but are not shown.
    """
    size = max(1, min(n, 50))
    kept = messages
    if before is not None:
        kept = kept.where(F.col("sequence_no") < before)
    if completed_only:
        kept = kept.where(F.col("status") == "completed")
    order = W.partitionBy("conversation_id").orderBy(F.desc("sequence_no"))
    page = kept.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= size + 1)
    more = F.max("_rn").over(W.partitionBy("conversation_id")) > size
    return (
        page.withColumn("has_more", more)
        .where((F.col("_rn") <= size) & F.col("role").isin("user", "assistant"))
        .drop("_rn")
    )


def assign_sequence(new_messages: DataFrame, existing: DataFrame, slice_seconds: int = 3600) -> DataFrame:
    """Numbers new messages after the stored maximum, by (created_at, message_id).

    With an empty ``existing`` this renumbers whole conversations.
    """
    slice_of = F.floor(F.unix_micros("created_at") / (slice_seconds * 1_000_000))
    numbered = number_rows(
        new_messages.drop("sequence_no"), ["conversation_id"],
        [F.asc("created_at"), F.asc("message_id")], slice_of, "_n",
    )
    stored = existing.groupBy("conversation_id").agg(F.max("sequence_no").alias("_max"))
    return (
        salted_join(numbered, stored, ["conversation_id"], ["message_id"], "left")
        .withColumn("sequence_no", F.col("_n") + F.coalesce("_max", F.lit(0)))
        .drop("_n", "_max")
    )


def message_facts(messages: DataFrame) -> DataFrame:
    """``(conversation_id, messages, last_at, first)``: what a rollup needs of some messages; ``first`` is the earliest user message.

    Facts of separate sets of messages add up, in any order, with :func:`merge_facts`.
    """
    opening = F.when(F.col("role") == "user", F.struct("sequence_no", "content"))
    return messages.groupBy("conversation_id").agg(
        F.count("*").alias("messages"), F.max("created_at").alias("last_at"), F.min(opening).alias("first")
    )


def merge_facts(facts: DataFrame) -> DataFrame:
    return facts.groupBy("conversation_id").agg(
        F.sum("messages").alias("messages"), F.max("last_at").alias("last_at"), F.min("first").alias("first")
    )


def rollup_conversations(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Adds message count, time of the last message, and a title from the first user message."""
    return apply_facts(conversations, message_facts(messages))


def apply_facts(conversations: DataFrame, facts: DataFrame) -> DataFrame:
    """The rollup from :func:`message_facts`."""
    facts = facts.select(
        "conversation_id", F.col("messages").alias("_count"), F.col("last_at").alias("_last"), F.col("first.content").alias("_first")
    )
    untitled = F.coalesce("title", F.lit("")).isin("", fixed.DEFAULT_TITLE)
    auto = F.substring(F.replace(strip(F.col("_first")), F.lit("\n"), F.lit(" ")), 1, 40)
    auto = F.when(auto != "", auto).otherwise(fixed.DEFAULT_TITLE)
    return (
        conversations.drop("message_count").join(facts, "conversation_id", "left")
        .withColumn("message_count", F.coalesce("_count", F.lit(0)))
        .withColumn("last_message_at", F.coalesce("_last", "last_message_at"))
        .withColumn("title", F.when(untitled & F.col("_first").isNotNull(), auto).otherwise(F.col("title")))
        .drop("_count", "_last", "_first")
    )


def drop_resubmitted(new_messages: DataFrame, existing: DataFrame) -> DataFrame:
    """First submission of each (conversation, client message id); others and null ids: see below.

    Messages without a client id are always kept.
    """
    key = ["conversation_id", "client_message_id"]
    named = new_messages.where(F.col("client_message_id").isNotNull())
    first = named.groupBy(*key).agg(
        F.min_by(F.struct(*[c for c in named.columns if c not in key]), F.struct("created_at", "message_id")).alias("_m")
    ).select(*key, "_m.*").select(*new_messages.columns)
    fresh = first.join(existing.select(*key), key, "left_anti")
    return fresh.unionByName(new_messages.where(F.col("client_message_id").isNull()))


def _newest(messages: DataFrame, n: int) -> DataFrame:
    """Newest ``n`` completed messages per conversation, numbered from the newest."""
    order = W.partitionBy("conversation_id").orderBy(F.desc("sequence_no"))
    return (
        messages.where(F.col("status") == "completed")
        .withColumn("newest", F.row_number().over(order))
        .where(F.col("newest") <= n)
    )


def recent_memory(messages: DataFrame, n: int = 8, budget: int = 2500) -> DataFrame:
    """The last messages that fit the token budget; the newest one always stays."""
    sized = _newest(messages, n).withColumn("tokens", estimate_tokens_ws(F.col("content")))
    upto = W.partitionBy("conversation_id").orderBy("newest").rowsBetween(W.unboundedPreceding, 0)
    return (
        sized.withColumn("used", F.sum("tokens").over(upto))
        .where((F.col("newest") == 1) | (F.col("used") <= budget))
        .select("conversation_id", "message_id", "sequence_no", "role", "content", "tokens")
    )


def memory_list(recent: DataFrame) -> DataFrame:
    """One row per conversation with its (at most n) recent messages in order."""
    return recent.groupBy("conversation_id").agg(
        F.array_sort(F.collect_list(F.struct("sequence_no", "role", "content"))).alias("recent_messages")
    )


def unsummarized(conversations: DataFrame, messages: DataFrame, n: int = 8) -> DataFrame:
    """All messages older than the newest ``n`` that the stored summary does not cover yet.

    Sequence numbers are unique in a conversation, so the ``n``-th newest one is a
    bound: the whole history is filtered by it, not sorted.
    """
    bound = _newest(messages.select("conversation_id", "sequence_no", "status"), n).groupBy("conversation_id").agg(
        F.min("sequence_no").alias("_oldest_recent")
    )
    covered = conversations.select("conversation_id", F.coalesce("summarized_through_sequence", F.lit(0)).alias("_covered"))
    return (
        messages.where(F.col("status") == "completed")
        .join(bound.join(covered, "conversation_id"), "conversation_id")
        .where((F.col("sequence_no") < F.col("_oldest_recent")) & (F.col("sequence_no") > F.col("_covered")))
        .select(*messages.columns)
    )


def clip_summary(c: Column, max_chars: int = 4000, head: int = 600) -> Column:
    """Keep head and tail of a summary that grew too long."""
    tail = max_chars - head - 3
    return F.when(
        F.length(c) > max_chars,
        F.concat(F.substring(c, 1, head), F.lit("\n…\n"), F.substring(c, -tail, tail)),
    ).otherwise(c)


# Role, colon and line break around an empty text.
SHORTEST_LINE = 4


def roll_summary(
    conversations: DataFrame, messages: DataFrame, n: int = 8, max_chars: int = 4000
) -> DataFrame:
    """One summary step per conversation: ``conversation_id, summary, summarized_through_sequence``.

    A line takes at least ``SHORTEST_LINE`` characters, and a long summary keeps its two ends. So the
    first and the last ``max_chars / SHORTEST_LINE`` lines decide the text, whatever the
    length of the history, and no more than these are put together in a row.
    """
    line = summary_line(F.col("role"), F.col("content"))
    ends = max_chars // SHORTEST_LINE + 1
    of = W.partitionBy("conversation_id")
    lines = unsummarized(conversations, messages, n).select("conversation_id", "sequence_no", line.alias("line"))
    first = lines.withColumn("_rn", F.row_number().over(of.orderBy("sequence_no"))).where(F.col("_rn") <= ends)
    last = lines.withColumn("_rn", F.row_number().over(of.orderBy(F.desc("sequence_no")))).where(F.col("_rn") <= ends)
    added = (
        first.unionByName(last)
        .select("conversation_id", F.struct("sequence_no", "line").alias("l"))
        .groupBy("conversation_id")
        .agg(F.array_sort(F.collect_set("l")).alias("lines"), F.max("l.sequence_no").alias("_through"))
    )
    text = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    stored = F.coalesce("summary", F.lit(""))
    joined = strip(F.concat_ws("\n", F.when(stored != "", stored), F.when(text != "", text)))
    return conversations.join(added, "conversation_id", "left").select(
        "conversation_id",
        F.when(F.col("lines").isNull(), stored).otherwise(clip_summary(joined, max_chars)).alias("summary"),
        F.coalesce("_through", "summarized_through_sequence", F.lit(0)).alias("summarized_through_sequence"),
    )


def active(conversations: DataFrame) -> DataFrame:
    return conversations.where(F.col("deleted_at").isNull())


def soft_delete(conversations: DataFrame, ids: DataFrame, as_of) -> DataFrame:
    """Marks the conversations in ``ids`` deleted and ends their running answers."""
    marked = ids.select("conversation_id").distinct().withColumn("_gone", F.lit(True))
    gone = F.coalesce("_gone", F.lit(False))
    changes = {
        "deleted_at": F.lit(as_of).cast("timestamp"),
        "status": F.lit("deleted"),
        "active_generation_id": F.lit(None),
        "generation_started_at": F.lit(None),
    }
    out = conversations.join(marked, "conversation_id", "left")
    for name, value in changes.items():
        if name in conversations.columns:
            out = out.withColumn(name, F.when(gone, value).otherwise(F.col(name)))
    return out.select(*conversations.columns)


def stale_generations(conversations: DataFrame, as_of, minutes: int = 2) -> DataFrame:
    """Running answers that started too long ago."""
    limit = F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {int(minutes)} MINUTES")
    return active(conversations).where(
        F.col("active_generation_id").isNotNull() & (F.col("generation_started_at") < limit)
    )


def full_conversations(conversations: DataFrame, cap: int = 40) -> DataFrame:
    return conversations.where(F.coalesce("message_count", F.lit(0)) >= cap)


def expired_conversations(conversations: DataFrame, as_of, days: int) -> DataFrame:
    """Conversations without activity for ``days`` days."""
    return conversations.where(F.col("last_active_at") < F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {int(days)} DAYS"))


def expired_visitors(visitors: DataFrame, as_of) -> DataFrame:
    """Visitors that expired or were revoked."""
    return visitors.where((F.col("expires_at") < F.lit(as_of).cast("timestamp")) | F.col("revoked_at").isNotNull())


def apply_retention(tables: dict[str, DataFrame], as_of, days: int) -> dict[str, DataFrame]:
    """Tables after retention, and ``removed``: how many conversations were too old.

    Deletions run down the tree (visitors, conversations, messages, feedback) as
    anti-joins.
    """
    conversations, visitors = tables["conversations"], tables["visitors"]
    expired = expired_conversations(conversations, as_of, days).select("conversation_id")
    gone_visitors = expired_visitors(visitors, as_of).select("visitor_id")
    orphaned = conversations.join(gone_visitors, "visitor_id", "left_semi").select("conversation_id")
    gone = expired.unionByName(orphaned).distinct()
    messages = tables["messages"]
    gone_messages = messages.join(gone, "conversation_id", "left_semi").select("message_id")
    return {
        "visitors": visitors.join(gone_visitors, "visitor_id", "left_anti"),
        "conversations": conversations.join(gone, "conversation_id", "left_anti"),
        "messages": messages.join(gone, "conversation_id", "left_anti"),
        "feedback": tables["feedback"].join(gone_messages, "message_id", "left_anti"),
        "removed": expired.agg(F.count("*").alias("removed")),
    }


def transcript_with_feedback(messages: DataFrame, feedback: DataFrame, limit: int | None = None) -> DataFrame:
    """The messages of each conversation (its newest ``limit``, if given) with the feedback they got."""
    page = messages
    if limit is not None:
        order = W.partitionBy("conversation_id").orderBy(F.desc("sequence_no"))
        page = messages.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= limit).drop("_rn")
    given = feedback.where(F.col("message_id").isNotNull()).select(
        "message_id", F.struct("rating", "reason", "comment").alias("feedback")
    )
    shown = F.when(F.col("role") == "user", display_text(F.col("content"))).otherwise(F.col("content"))
    return (
        page.where(F.col("role").isin("user", "assistant"))
        .withColumn("content", shown)
        .join(given, "message_id", "left")
    )


def owned_answers(messages: DataFrame, conversations: DataFrame, visitors: DataFrame | None = None) -> DataFrame:
    """Assistant messages of conversations that are not deleted (of the given visitors)."""
    owners = active(conversations)
    if visitors is not None:
        owners = owners.join(visitors.select("visitor_id"), "visitor_id", "left_semi")
    answers = messages.where(F.col("role") == "assistant")
    return answers.join(owners.select("conversation_id"), "conversation_id", "left_semi")


def complete_answers(messages: DataFrame, completions: DataFrame, as_of) -> DataFrame:
    """Writes the final fields of finished answers; the latest completion of a message wins."""
    fields = ["content", "status", "model_name", "estimated_input_tokens", "estimated_output_tokens", "latency_ms"]
    final = latest(completions, ["message_id"], ["completed_at"]).select(
        "message_id", F.struct(*fields).alias("_final")
    )
    out = messages.join(final, "message_id", "left")
    for name in fields:
        out = out.withColumn(name, F.when(F.col("_final").isNotNull(), F.col(f"_final.{name}")).otherwise(F.col(name)))
    return out.withColumn(
        "updated_at", F.when(F.col("_final").isNotNull(), F.lit(as_of).cast("timestamp")).otherwise(F.col("updated_at"))
    ).drop("_final")
