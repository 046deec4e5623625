"""Conversation, feedback, visitor and admission queries over conversations and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from driver_queries.registry import Registry
from driver_queries.tables import load
from evidentia.functions import text as tx
from evidentia.operators import conversations as cv, feedback as fb, limiter, visitors as vs
from evidentia.plans import retention
from evidentia.sources import bucketed
from evidentia.streaming import runs

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

AS_OF = "2024-01-04 00:00:00"


def messages(spark, sf_dir):
    turn, conv = F.col("turn"), F.col("conv_id")
    number = conv * 1000 + turn
    return load(spark, sf_dir, "conversations").select(
        number.alias("message_id"),
        conv.alias("conversation_id"),
        (turn + 1).cast("int").alias("sequence_no"),
        "role",
        F.col("text").alias("content"),
        F.when(turn % 7 == 6, "failed").otherwise("completed").alias("status"),
        F.when(F.col("role") == "user", conv * 1000 + F.floor(turn / 4)).alias("client_message_id"),
        F.timestamp_seconds(F.lit(1704067200) + conv * 3600 + turn * 97).alias("created_at"),
    )


def conversations(spark, sf_dir):
    conv = F.col("conversation_id")
    return (
        messages(spark, sf_dir)
        .groupBy("conversation_id")
        .agg(
            F.min("created_at").alias("created_at"),
            F.max("created_at").alias("last_active_at"),
            F.count("*").alias("message_count"),
        )
        .select(
            "conversation_id",
            (conv % 40).alias("visitor_id"),
            F.when(conv % 3 == 0, "新对话").when(conv % 3 == 1, F.concat(F.lit("Talk "), conv.cast("string"))).alias("title"),
            "created_at",
            "last_active_at",
            F.when(conv % 11 != 0, F.col("last_active_at")).alias("last_message_at"),
            F.when(conv % 5 == 0, F.col("last_active_at")).alias("deleted_at"),
            F.lit("active").alias("status"),
            F.when(conv % 4 == 0, "earlier talk").alias("summary"),
            F.when(conv % 4 == 0, 1).otherwise(0).alias("summarized_through_sequence"),
            F.when(conv % 6 == 0, conv).alias("active_generation_id"),
            F.when(conv % 6 == 0, F.col("created_at")).alias("generation_started_at"),
            "message_count",
        )
    )


def visitors(spark, sf_dir):
    user = F.col("user_id")
    return (
        load(spark, sf_dir, "events").groupBy("user_id")
        .agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
        .select(
            user.alias("visitor_id"),
            vs.token_hash(F.concat(F.lit("token-"), user.cast("string"))).alias("token_hash"),
            F.col("first_ts").alias("last_seen_at"),
            F.timestamp_seconds(F.unix_seconds("first_ts") + 86400 * 3 + user * 600).alias("expires_at"),
            F.when(user % 10 == 0, F.col("last_ts")).alias("revoked_at"),
        )
    )


def feedback(spark, sf_dir):
    kind = F.col("event_type")
    return load(spark, sf_dir, "events").select(
        F.col("event_id").alias("feedback_id"),
        F.when(kind != "view", (F.col("event_id") % 100) * 1000 + F.col("user_id") % 5).alias("message_id"),
        F.when(kind == "error", -1).when(kind == "signup", 0).otherwise(1).cast("int").alias("rating"),
        F.when(kind == "error", "信息错误").when(kind == "signup", "other").alias("reason"),
        F.col("props").alias("comment"),
        F.col("ts").alias("created_at"),
    )


BASE = """msgs AS (
  SELECT conv_id * 1000 + turn AS message_id, conv_id AS conversation_id, CAST(turn + 1 AS INTEGER) AS sequence_no, role, text AS content,
    CASE WHEN turn % 7 = 6 THEN 'failed' ELSE 'completed' END AS status,
    CASE WHEN role = 'user' THEN conv_id * 1000 + turn // 4 END AS client_message_id,
    1704067200 + conv_id * 3600 + turn * 97 AS created_s
  FROM conversations
),
convs AS (
  SELECT c AS conversation_id, c % 40 AS visitor_id,
    CASE c % 3 WHEN 0 THEN '新对话' WHEN 1 THEN 'Talk ' || c END AS title, created_s, active_s,
    CASE WHEN c % 11 <> 0 THEN active_s END AS last_message_s, c % 5 = 0 AS deleted,
    CASE WHEN c % 4 = 0 THEN 'earlier talk' END AS summary, CASE WHEN c % 4 = 0 THEN 1 ELSE 0 END AS through,
    c % 6 = 0 AS generating, n AS message_count
  FROM (SELECT conversation_id AS c, min(created_s) AS created_s, max(created_s) AS active_s, count(*) AS n FROM msgs GROUP BY 1)
),
visitors AS (
  SELECT user_id AS visitor_id, sha256('token-' || user_id) AS token_hash, min(ts) AS last_seen,
    epoch(date_trunc('second', min(ts)))::BIGINT + 86400 * 3 + user_id * 600 AS expires_s, user_id % 10 = 0 AS revoked
  FROM events GROUP BY user_id
),
fb AS (
  SELECT event_id AS feedback_id, CASE WHEN event_type <> 'view' THEN (event_id % 100) * 1000 + user_id % 5 END AS message_id,
    CASE event_type WHEN 'error' THEN -1 WHEN 'signup' THEN 0 ELSE 1 END AS rating,
    CASE event_type WHEN 'error' THEN '信息错误' WHEN 'signup' THEN 'other' END AS reason, props AS comment, ts
  FROM events
),
now AS (SELECT epoch(TIMESTAMP '2024-01-04 00:00:00')::BIGINT AS s)"""
W = f"WITH {BASE} "
_ORDER = "last_message_s DESC NULLS LAST, created_s DESC, conversation_id"
SECONDS = lambda c: F.unix_seconds(c)


@query(
    W + f", latest AS (SELECT conversation_id, arg_max(content, sequence_no) AS m FROM msgs GROUP BY 1),"
    f" ranked AS (SELECT *, row_number() OVER (PARTITION BY visitor_id ORDER BY {_ORDER}) AS position FROM convs WHERE NOT deleted)"
    " SELECT visitor_id, position, conversation_id, CASE WHEN coalesce(title, '') = '' THEN '新对话' ELSE title END AS title,"
    " substr(m, 1, 80) AS last_message_preview, coalesce(last_message_s, active_s, created_s) AS updated_s"
    " FROM ranked LEFT JOIN latest USING (conversation_id) WHERE position <= 30"
)
def list_owned(spark, sf_dir):
    return cv.list_owned(conversations(spark, sf_dir), messages(spark, sf_dir)).withColumn(
        "updated_s", SECONDS(F.col("updated_at"))
    ).drop("updated_at")


@query(
    W + ", ends AS (SELECT conversation_id, arg_min(content, sequence_no) FILTER (role = 'user') AS first_question,"
    " arg_max(content, sequence_no) AS last_message_preview FROM msgs GROUP BY 1)"
    f" SELECT conversation_id, coalesce(first_question, '') AS first_question, last_message_preview"
    f" FROM (SELECT * FROM convs ORDER BY {_ORDER} LIMIT 100) LEFT JOIN ends USING (conversation_id)"
)
def list_admin(spark, sf_dir):
    return cv.list_admin(conversations(spark, sf_dir), messages(spark, sf_dir)).select(
        "conversation_id", F.coalesce("first_question", F.lit("")).alias("first_question"), "last_message_preview"
    )


@query(
    W + " SELECT conversation_id FROM convs c WHERE title ILIKE '%k 1%' OR EXISTS"
    " (SELECT 1 FROM msgs m WHERE m.conversation_id = c.conversation_id AND m.content ILIKE '%k 1%')"
    " UNION SELECT conversation_id FROM msgs WHERE content ILIKE '%the_ed%'"
)
def search_conversations(spark, sf_dir):
    convs, msgs = conversations(spark, sf_dir), messages(spark, sf_dir)
    by_title = cv.search_conversations(convs, msgs, "k 1")
    by_text = cv.search_conversations(convs, msgs, "the_ed")
    return by_title.select("conversation_id").union(by_text.select("conversation_id")).distinct()


@query(
    W + " SELECT (SELECT count(*) FROM convs) AS conversations, (SELECT count(*) FROM visitors) AS visitors,"
    " (SELECT count(*) FROM msgs) AS messages, (SELECT count(*) FROM fb) AS feedback"
)
def activity_totals(spark, sf_dir):
    return cv.activity_totals(
        conversations(spark, sf_dir), visitors(spark, sf_dir), messages(spark, sf_dir), feedback(spark, sf_dir)
    )


@query(
    W + ", p AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY sequence_no DESC) AS rn,"
    " count(*) OVER (PARTITION BY conversation_id) > 3 AS has_more FROM msgs WHERE sequence_no < 9 AND status = 'completed')"
    " SELECT message_id, sequence_no, role, has_more FROM p WHERE rn <= 3 AND role IN ('user', 'assistant')"
)
def message_page(spark, sf_dir):
    return cv.message_page(messages(spark, sf_dir), 3, before=9, completed_only=True).select(
        "message_id", "sequence_no", "role", "has_more"
    )


@query(
    W + ", stored AS (SELECT conversation_id, max(sequence_no) AS top FROM msgs WHERE status = 'failed' GROUP BY 1)"
    " SELECT message_id, row_number() OVER (PARTITION BY conversation_id ORDER BY created_s, message_id) + coalesce(top, 0) AS sequence_no"
    " FROM msgs LEFT JOIN stored USING (conversation_id)"
)
def assign_sequence(spark, sf_dir):
    msgs = messages(spark, sf_dir)
    return cv.assign_sequence(msgs, msgs.where("status = 'failed'"), slice_seconds=300).select("message_id", "sequence_no")


ROLLUP_SQL = (
    W + ", facts AS (SELECT conversation_id, count(*) AS n, max(created_s) AS last_s, arg_min(content, sequence_no) FILTER (role = 'user') AS q FROM msgs GROUP BY 1)"
    " SELECT conversation_id, n AS message_count, last_s,"
    " CASE WHEN coalesce(title, '') IN ('', '新对话') AND q IS NOT NULL"
    " THEN coalesce(nullif(substr(replace(regexp_replace(q, '^\\s+|\\s+$', '', 'g'), chr(10), ' '), 1, 40), ''), '新对话') ELSE coalesce(title, '') END AS title"
    " FROM convs JOIN facts USING (conversation_id)"
)


@query(ROLLUP_SQL)
def rollup_conversations(spark, sf_dir):
    return cv.rollup_conversations(conversations(spark, sf_dir), messages(spark, sf_dir)).select(
        "conversation_id", "message_count", SECONDS(F.col("last_message_at")).alias("last_s"),
        F.coalesce("title", F.lit("")).alias("title"),
    )


@query(
    W + ", stored AS (SELECT conversation_id, client_message_id FROM msgs WHERE status = 'failed' AND client_message_id IS NOT NULL),"
    " firsts AS (SELECT *, row_number() OVER (PARTITION BY conversation_id, client_message_id ORDER BY created_s, message_id) AS rn FROM msgs)"
    " SELECT message_id FROM firsts f WHERE client_message_id IS NULL OR (rn = 1 AND NOT EXISTS (SELECT 1 FROM stored s"
    " WHERE s.conversation_id = f.conversation_id AND s.client_message_id = f.client_message_id))"
)
def drop_resubmitted(spark, sf_dir):
    msgs = messages(spark, sf_dir)
    return cv.drop_resubmitted(msgs, msgs.where("status = 'failed'")).select("message_id")


# Token estimate over white-space parts; the tables hold no wide characters.
_TOKENS_WS = (
    "coalesce(list_sum(list_transform(list_filter(regexp_split_to_array({0}, '\\s+'), lambda p: p <> ''),"
    " lambda p: greatest(1, (length(p) + 3) // 4))), 0)::BIGINT"
)


@query(
    W + f", n AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY sequence_no DESC) AS rn, {_TOKENS_WS.format('content')} AS tokens"
    " FROM msgs WHERE status = 'completed'),"
    " u AS (SELECT *, sum(tokens) OVER (PARTITION BY conversation_id ORDER BY rn) AS used FROM n WHERE rn <= 8)"
    " SELECT message_id, sequence_no, tokens FROM u WHERE rn = 1 OR used <= 250"
)
def recent_memory(spark, sf_dir):
    return cv.recent_memory(messages(spark, sf_dir), budget=250).select("message_id", "sequence_no", "tokens")


_OLD = (
    ", n AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY sequence_no DESC) AS rn FROM msgs WHERE status = 'completed'),"
    " old AS (SELECT n.* FROM n JOIN convs USING (conversation_id) WHERE rn > 2 AND sequence_no > through)"
)


@query(W + _OLD + " SELECT message_id FROM old")
def unsummarized(spark, sf_dir):
    return cv.unsummarized(conversations(spark, sf_dir), messages(spark, sf_dir), n=2).select("message_id")


_LINE = (
    "CASE WHEN role = 'user' THEN '用户' ELSE '助手' END || '：' ||"
    " CASE WHEN length(flat) > 240 THEN substr(flat, 1, 237) || '...' ELSE flat END"
)
_FLAT = "regexp_replace(regexp_replace(content, '\\s+', ' ', 'g'), '^ | $', '', 'g')"


@query(W + f" SELECT message_id, {_LINE} AS line FROM (SELECT *, {_FLAT} AS flat FROM msgs)")
def summary_lines(spark, sf_dir):
    return messages(spark, sf_dir).select(
        "message_id", tx.summary_line(F.col("role"), F.col("content")).alias("line")
    )


@query(
    W + _OLD + f", lines AS (SELECT conversation_id, string_agg({_LINE}, chr(10) ORDER BY sequence_no) AS t, max(sequence_no) AS top"
    f" FROM (SELECT *, {_FLAT} AS flat FROM old) GROUP BY 1),"
    " s AS (SELECT conversation_id, through, top, CASE WHEN t IS NULL THEN coalesce(summary, '') WHEN summary IS NULL THEN t ELSE summary || chr(10) || t END AS j"
    " FROM convs LEFT JOIN lines USING (conversation_id))"
    " SELECT conversation_id, CASE WHEN length(j) > 900 THEN substr(j, 1, 600) || chr(10) || '…' || chr(10) || substr(j, -297) ELSE j END AS summary,"
    " coalesce(top, through) AS summarized_through_sequence FROM s"
)
def roll_summary(spark, sf_dir):
    return cv.roll_summary(conversations(spark, sf_dir), messages(spark, sf_dir), n=2, max_chars=900)


@query(
    W + ", f AS (SELECT * FROM fb WHERE message_id IS NOT NULL AND ts >= TIMESTAMP '2024-01-20'),"
    " o AS (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY ts DESC, feedback_id DESC) AS rn FROM fb WHERE message_id IS NOT NULL AND ts < TIMESTAMP '2024-01-20'),"
    " stored AS (SELECT * FROM o WHERE rn = 1),"
    " fresh AS (SELECT message_id, arg_max(rating, (ts, feedback_id)) AS rating, arg_min(feedback_id, (ts, feedback_id)) AS fid FROM f GROUP BY 1)"
    " SELECT coalesce(s.feedback_id, x.fid) AS feedback_id, message_id, coalesce(x.rating, s.rating) AS rating FROM stored s FULL JOIN fresh x USING (message_id)"
)
def upsert_feedback(spark, sf_dir):
    given = feedback(spark, sf_dir).where(F.col("message_id").isNotNull())
    cut = F.lit("2024-01-20").cast("timestamp")
    stored = fb.dedupe_feedback(given.where(F.col("created_at") < cut))
    return fb.upsert_feedback(stored, given.where(F.col("created_at") >= cut)).select("feedback_id", "message_id", "rating")


@query(
    W + " SELECT feedback_id FROM (SELECT feedback_id, message_id, row_number() OVER (PARTITION BY message_id ORDER BY ts DESC, feedback_id DESC) AS rn FROM fb)"
    " WHERE rn = 1 OR message_id IS NULL"
)
def dedupe_feedback(spark, sf_dir):
    return fb.dedupe_feedback(feedback(spark, sf_dir)).select("feedback_id")


@query(
    W + " SELECT m.message_id FROM msgs m JOIN convs c USING (conversation_id) WHERE m.role = 'assistant' AND NOT c.deleted"
    " AND c.visitor_id IN (SELECT visitor_id FROM visitors WHERE NOT revoked)"
)
def owned_answers(spark, sf_dir):
    known = visitors(spark, sf_dir).where(F.col("revoked_at").isNull())
    return cv.owned_answers(messages(spark, sf_dir), conversations(spark, sf_dir), known).select("message_id")


_GONE = (
    ", gone_v AS (SELECT visitor_id FROM visitors, now WHERE revoked OR expires_s < s),"
    " old AS (SELECT conversation_id FROM convs, now WHERE active_s < s - 86400),"
    " gone AS (SELECT conversation_id FROM old UNION SELECT conversation_id FROM convs WHERE visitor_id IN (SELECT visitor_id FROM gone_v)),"
    " kept_m AS (SELECT * FROM msgs WHERE conversation_id NOT IN (SELECT conversation_id FROM gone)),"
    " gone_m AS (SELECT message_id FROM msgs WHERE conversation_id IN (SELECT conversation_id FROM gone))"
)


@query(
    W + _GONE +
    " SELECT 'visitors' AS name, count(*) AS n FROM visitors WHERE visitor_id NOT IN (SELECT visitor_id FROM gone_v)"
    " UNION ALL SELECT 'conversations', count(*) FROM convs WHERE conversation_id NOT IN (SELECT conversation_id FROM gone)"
    " UNION ALL SELECT 'messages', count(*) FROM kept_m"
    " UNION ALL SELECT 'feedback', count(*) FROM fb WHERE message_id IS NULL OR message_id NOT IN (SELECT message_id FROM gone_m)"
    " UNION ALL SELECT 'removed', count(*) FROM old"
)
def apply_retention(spark, sf_dir):
    """Rows left in each table, and how many conversations were too old."""
    kept = cv.apply_retention(
        {
            "visitors": visitors(spark, sf_dir), "conversations": conversations(spark, sf_dir),
            "messages": messages(spark, sf_dir), "feedback": feedback(spark, sf_dir),
        },
        AS_OF, 1,
    )
    out = kept.pop("removed").select(F.lit("removed").alias("name"), F.col("removed").alias("n"))
    for name, df in kept.items():
        out = out.unionByName(df.agg(F.count("*").alias("n")).withColumn("name", F.lit(name)))
    return out


@query(
    W + _GONE
    + " SELECT 'visitors' AS name, count(*) AS n, sum(visitor_id) AS ids, (SELECT count(*) FROM gone_v) AS removed FROM visitors WHERE visitor_id NOT IN (SELECT visitor_id FROM gone_v)"
    " UNION ALL SELECT 'conversations', count(*), sum(conversation_id), (SELECT count(*) FROM gone) FROM convs WHERE conversation_id NOT IN (SELECT conversation_id FROM gone)"
    " UNION ALL SELECT 'messages', count(*), sum(message_id), (SELECT count(*) FROM gone_m) FROM kept_m"
    " UNION ALL SELECT 'feedback', count(*), sum(feedback_id), (SELECT count(*) FROM fb WHERE message_id IN (SELECT message_id FROM gone_m))"
    " FROM fb WHERE message_id IS NULL OR message_id NOT IN (SELECT message_id FROM gone_m)"
)
def retention_job(spark, sf_dir):
    """The job on a store of all conversation tables: what is left of each, and how many rows went."""
    root = runs.new_folder(spark, "retention")
    tables = {
        "visitors": visitors(spark, sf_dir), "conversations": conversations(spark, sf_dir),
        "messages": messages(spark, sf_dir), "feedback": feedback(spark, sf_dir),
    }
    retention.create_store(spark, root, tables, buckets=8)
    report = retention.retention_job(spark, root, AS_OF, 1).first()
    ids = {"visitors": "visitor_id", "conversations": "conversation_id", "messages": "message_id", "feedback": "feedback_id"}
    out = None
    for name, column in ids.items():
        left = bucketed.read(spark, root, name).agg(F.count("*").alias("n"), F.sum(column).cast("long").alias("ids"))
        row = left.select(F.lit(name).alias("name"), "n", "ids", F.lit(report[name]).cast("long").alias("removed"))
        out = row if out is None else out.unionByName(row)
    return out


@query(
    W + ", f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY ts DESC, feedback_id DESC) AS rn FROM fb WHERE message_id IS NOT NULL) WHERE rn = 1)"
    " SELECT m.message_id, coalesce(f.rating, 9) AS rating, coalesce(f.reason, '') AS reason, md5(m.content) AS content_md5"
    " FROM msgs m LEFT JOIN f USING (message_id) WHERE m.role IN ('user', 'assistant')"
)
def transcript_with_feedback(spark, sf_dir):
    given = fb.dedupe_feedback(feedback(spark, sf_dir))
    return cv.transcript_with_feedback(messages(spark, sf_dir), given).select(
        "message_id", F.coalesce("feedback.rating", F.lit(9)).alias("rating"),
        F.coalesce("feedback.reason", F.lit("")).alias("reason"), F.md5("content").alias("content_md5"),
    )


@query(
    W + " SELECT feedback_id, rating IN (-1, 1) AS rating_ok, reason IS NULL OR reason = '信息错误' AS reason_ok,"
    " rating IN (-1, 1) AND (reason IS NULL OR reason = '信息错误') AND length(comment) <= 500 AS valid FROM fb"
)
def check_feedback(spark, sf_dir):
    return fb.check_feedback(feedback(spark, sf_dir)).select("feedback_id", "rating_ok", "reason_ok", "valid")


@query(
    W + " SELECT conversation_id FROM convs, now WHERE NOT deleted AND generating AND created_s < s - 120"
)
def stale_generations(spark, sf_dir):
    return cv.stale_generations(conversations(spark, sf_dir), AS_OF).select("conversation_id")


@query(W + " SELECT conversation_id, deleted OR conversation_id % 3 = 1 AS gone, CASE WHEN conversation_id % 3 = 1 THEN 'deleted' ELSE 'active' END AS status,"
       " generating AND conversation_id % 3 <> 1 AS generating FROM convs")
def soft_delete(spark, sf_dir):
    convs = conversations(spark, sf_dir)
    ids = convs.where(F.col("conversation_id") % 3 == 1)
    return cv.soft_delete(convs, ids, AS_OF).select(
        "conversation_id", F.col("deleted_at").isNotNull().alias("gone"), "status",
        F.col("active_generation_id").isNotNull().alias("generating"),
    )


@query(W + " SELECT conversation_id, message_count FROM convs WHERE message_count >= 6")
def full_conversations(spark, sf_dir):
    return cv.full_conversations(conversations(spark, sf_dir), cap=6).select("conversation_id", "message_count")


@query(
    W + " SELECT visitor_id, CASE WHEN epoch_us(last_seen) <= (s - 3600) * 1000000 THEN s * 1000000 ELSE epoch_us(last_seen) END AS seen_us"
    " FROM visitors, now WHERE NOT revoked AND expires_s > s AND visitor_id % 2 = 1"
)
def valid_visitors(spark, sf_dir):
    """The odd visitors present their tokens."""
    known = visitors(spark, sf_dir)
    tokens = load(spark, sf_dir, "events").where(F.col("user_id") % 2 == 1).select(
        F.concat(F.lit("token-"), F.col("user_id").cast("string")).alias("token")
    )
    return vs.valid_visitors(tokens, known, AS_OF).select("visitor_id", F.unix_micros("last_seen_at").alias("seen_us"))


@query(
    "SELECT event_id, substr(sha256('10.0.0.' || user_id || strftime(ts, '%Y-%m-%d') || 'salt'), 1, 16) AS pseudonym FROM events"
)
def pseudonymize(spark, sf_dir):
    address = F.concat(F.lit("10.0.0."), F.col("user_id").cast("string"))
    return load(spark, sf_dir, "events").select("event_id", vs.pseudonymize(address, F.col("ts"), "salt").alias("pseudonym"))


_PEER = "'10.' || (user_id % 4) || '.' || (event_id % 256) || '.' || (event_id % 300)"


@query(
    f"WITH r AS (SELECT event_id, {_PEER} AS peer, CASE event_type WHEN 'view' THEN ' 8.8.' || (user_id % 300) || '.1 ' WHEN 'click' THEN 'unknown' END AS forwarded,"
    " event_id % 300 < 256 AS peer_ok, user_id % 4 AS b, event_id % 256 AS c, event_id % 300 AS d, user_id % 300 < 256 AS fwd_ok FROM events)"
    " SELECT event_id, CASE WHEN peer_ok AND (b = 1 OR (b = 2 AND c < 16) OR (b = 3 AND c = 5 AND d = 5)) AND forwarded LIKE ' 8%' AND fwd_ok THEN trim(forwarded) ELSE peer END AS client_ip FROM r"
)
def resolve_client_ip(spark, sf_dir):
    n, user = F.col("event_id"), F.col("user_id")
    requests = load(spark, sf_dir, "events").select(
        "event_id",
        F.concat_ws(".", F.lit("10"), user % 4, n % 256, n % 300).alias("peer"),
        F.when(F.col("event_type") == "view", F.concat(F.lit(" 8.8."), (user % 300).cast("string"), F.lit(".1 ")))
        .when(F.col("event_type") == "click", "unknown").alias("forwarded"),
    )
    trusted = ["10.1.0.0/16", "10.2.3.4/20", "10.3.5.5"]
    return vs.resolve_client_ip(requests, trusted).select("event_id", "client_ip")


@query(
    W + ", done AS (SELECT message_id, arg_max(feedback_id, (ts, feedback_id)) AS f, arg_max(comment, (ts, feedback_id)) AS comment FROM fb WHERE message_id IS NOT NULL GROUP BY 1)"
    " SELECT message_id, coalesce(d.comment, m.content) AS content, CASE WHEN d.f IS NOT NULL THEN CASE WHEN d.f % 9 = 0 THEN 'stopped' ELSE 'completed' END ELSE status END AS status,"
    " coalesce(d.f % 500, -1) AS latency_ms FROM (SELECT * FROM msgs WHERE role = 'assistant') m LEFT JOIN done d USING (message_id)"
)
def complete_answers(spark, sf_dir):
    empty = {"model_name": "string", "estimated_input_tokens": "int", "estimated_output_tokens": "int", "latency_ms": "bigint", "updated_at": "timestamp"}
    answers = messages(spark, sf_dir).where(F.col("role") == "assistant")
    for name, kind in empty.items():
        answers = answers.withColumn(name, F.lit(None).cast(kind))
    finished = fb.dedupe_feedback(feedback(spark, sf_dir)).where(F.col("message_id").isNotNull()).select(
        "message_id", F.col("comment").alias("content"),
        F.when(F.col("feedback_id") % 9 == 0, "stopped").otherwise("completed").alias("status"),
        F.lit("m").alias("model_name"),
        tx.estimate_tokens_word(F.col("comment")).cast("int").alias("estimated_input_tokens"),
        F.lit(1).alias("estimated_output_tokens"),
        (F.col("feedback_id") % 500).alias("latency_ms"), F.col("created_at").alias("completed_at"),
    )
    return cv.complete_answers(answers, finished, AS_OF).select(
        "message_id", "content", "status", F.coalesce("latency_ms", F.lit(-1)).alias("latency_ms")
    )


# --- admission -----------------------------------------------------------------------


def requests(spark, sf_dir):
    return load(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_id"), F.col("user_id").cast("string").alias("client"), "ts", "event_type"
    )


def _log_sql(limit, window):
    """The rule itself, replayed per client by recursion."""
    return f"""WITH RECURSIVE r AS (
  SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events
),
log AS (
  SELECT event_id, user_id, n, [t] AS held, true AS accepted FROM r WHERE n = 1
  UNION ALL
  SELECT r.event_id, r.user_id, r.n,
         CASE WHEN len(list_filter(l.held, lambda h: r.t - h < {window * 1000000})) < {limit}
              THEN list_append(list_filter(l.held, lambda h: r.t - h < {window * 1000000}), r.t)
              ELSE list_filter(l.held, lambda h: r.t - h < {window * 1000000}) END,
         len(list_filter(l.held, lambda h: r.t - h < {window * 1000000})) < {limit}
  FROM log l JOIN r ON r.user_id = l.user_id AND r.n = l.n + 1
)"""


@query(_log_sql(2, 43200) + " SELECT event_id AS request_id, accepted FROM log")
def sliding_log_limit(spark, sf_dir):
    asked = requests(spark, sf_dir).withColumn("namespace", F.lit("chat")).withColumn("minute_limit", F.lit(2))
    return limiter.sliding_log_limit(asked, 43200).select("request_id", "accepted")


@query(
    _log_sql(1, 3600) + ", ok AS (SELECT event_id, date_trunc('day', to_timestamp(held[len(held)] / 1000000.0) AT TIME ZONE 'UTC') AS d, held[len(held)] AS t FROM log WHERE accepted)"
    " SELECT event_id AS request_id, row_number() OVER (PARTITION BY d ORDER BY t, event_id) <= 300 AS within_cap FROM ok"
)
def daily_cap(spark, sf_dir):
    asked = requests(spark, sf_dir).withColumn("namespace", F.lit("chat")).withColumn("minute_limit", F.lit(1))
    accepted = limiter.sliding_log_limit(asked, 3600).where("accepted")
    return limiter.daily_cap(accepted, 300).select("request_id", "within_cap")


def _held(logs, client, width):
    return f"list_filter(coalesce({logs}[{client}], CAST([] AS BIGINT[])), lambda h: t - h < {width})"


_ADMIT = f"""WITH RECURSIVE r AS (
  SELECT event_id, epoch_us(ts) AS t, CAST(ts AS DATE) AS d, user_id AS v, user_id % 20 AS ip,
         row_number() OVER (ORDER BY ts, event_id) AS n FROM events
),
sim AS (
  SELECT CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS event_id, MAP {{CAST(-1 AS BIGINT): CAST([] AS BIGINT[])}} AS ips,
         MAP {{CAST(-1 AS BIGINT): CAST([] AS BIGINT[])}} AS vs, DATE '1970-01-01' AS d, 0 AS used, false AS ip_ok, false AS accepted
  UNION ALL
  SELECT n, event_id, map_concat(ips, MAP {{ip: CASE WHEN ip_ok THEN list_append(ih, t) ELSE ih END}}),
         CASE WHEN ip_ok THEN map_concat(vs, MAP {{v: CASE WHEN ok THEN list_append(vh, t) ELSE vh END}}) ELSE vs END,
         d, used + CASE WHEN ok THEN 1 ELSE 0 END, ip_ok, ok
  FROM (
    SELECT *, ip_ok AND len(vh) < 1 AND used < 200 AS ok FROM (
      SELECT *, len(ih) < 6 AS ip_ok FROM (
        SELECT r.n, r.event_id, r.t, r.d, r.v, r.ip, s.ips, s.vs, CASE WHEN s.d = r.d THEN s.used ELSE 0 END AS used,
               {_held("s.ips", "r.ip", 21600000000)} AS ih, {_held("s.vs", "r.v", 21600000000)} AS vh
        FROM sim s JOIN r ON r.n = s.n + 1)))
)
SELECT event_id AS request_id, ip_ok, accepted FROM sim WHERE n > 0"""


@query(_ADMIT)
def admit(spark, sf_dir):
    asked = requests(spark, sf_dir).select(
        "request_id", "ts", F.col("client").alias("visitor"),
        F.concat(F.lit("10.0.0."), (F.col("client").cast("int") % 20).cast("string")).alias("ip"),
    )
    return limiter.admit(asked, ip_limit=6, visitor_limit=1, daily_limit=200, window_seconds=21600)


_POLICIES = f"""WITH RECURSIVE p(namespace, minute_limit, daily_limit) AS (
  VALUES ('view', 1, 40), ('click', 2, 50), ('error', 1, 1000000), ('signup', 2, 30), ('purchase', 1, 60)
),
r AS (
  SELECT event_id, epoch_us(ts) AS t, CAST(ts AS DATE) AS d, user_id AS v, event_type AS namespace, minute_limit, daily_limit,
         row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n
  FROM events JOIN p ON p.namespace = event_type
),
sim AS (
  SELECT namespace, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS event_id, MAP {{CAST(-1 AS BIGINT): CAST([] AS BIGINT[])}} AS logs,
         DATE '1970-01-01' AS d, 0 AS used, false AS accepted FROM p
  UNION ALL
  SELECT namespace, n, event_id, map_concat(logs, MAP {{v: CASE WHEN ok THEN list_append(held, t) ELSE held END}}),
         d, used + CASE WHEN ok THEN 1 ELSE 0 END, ok
  FROM (
    SELECT *, len(held) < minute_limit AND used < daily_limit AS ok FROM (
      SELECT r.*, s.logs, CASE WHEN s.d = r.d THEN s.used ELSE 0 END AS used,
             {_held("s.logs", "r.v", 43200000000)} AS held
      FROM sim s JOIN r ON r.namespace = s.namespace AND r.n = s.n + 1))
)
SELECT event_id AS request_id, namespace, accepted FROM sim WHERE n > 0"""


@query(_POLICIES)
def admit_by_policy(spark, sf_dir):
    """Every event type is a namespace with its own limits."""
    policies = spark.createDataFrame(
        [("view", 1, 40), ("click", 2, 50), ("error", 1, None), ("signup", 2, 30), ("purchase", 1, 60)],
        "namespace string, minute_limit int, daily_limit int",
    )
    asked = requests(spark, sf_dir).withColumnRenamed("event_type", "namespace")
    return limiter.admit_by_policy(asked, policies, window_seconds=43200).select("request_id", "namespace", "accepted")
