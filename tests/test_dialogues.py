import random
import re
from collections import Counter, defaultdict, deque
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from evidentia.operators import conversations as cv, feedback as fb, limiter, visitors as vs
from evidentia.operators.skew import number_rows
from evidentia.streaming import limiter as stream_limiter, memory, runs
from evidentia.streaming.tables import compact, read_latest, stream_ingest
from evidentia.plans.ingest import stored

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
MESSAGE = "message_id long, conversation_id long, sequence_no int, role string, content string, status string"


def requests(spark, rows):
    return spark.createDataFrame(
        [(i, c, START + timedelta(seconds=s)) for i, (c, s) in enumerate(rows)], "request_id long, client string, ts timestamp"
    )


def brute(rows, limit, daily, window):
    """The rule, request by request."""
    logs, used, out = defaultdict(deque), Counter(), []
    for i, (client, second) in sorted(enumerate(rows), key=lambda r: (r[1][1], r[0])):
        log, day = logs[client], int(second // 86400)
        while log and second - log[0] >= window:
            log.popleft()
        ok = len(log) < limit and (daily is None or used[day] < daily)
        if ok:
            log.append(second)
            used[day] += 1
        out.append((i, ok))
    return dict(out)


def test_minute_edge(spark):
    asked = requests(spark, [("a", 0), ("a", 1), ("a", 2), ("a", 61)]).withColumn("namespace", F.lit("n")).withColumn("minute_limit", F.lit(2))
    got = {r.request_id: r.accepted for r in limiter.sliding_log_limit(asked).collect()}
    assert got == {0: True, 1: True, 2: False, 3: True}


@pytest.mark.parametrize("limit,daily,window", [(1, None, 60), (3, 40, 60), (2, 15, 7200), (5, 1, 600)])
def test_limiter_equals_brute_force(spark, limit, daily, window):
    rng = random.Random(limit)
    # One client sends a third of all requests; many arrive around midnight.
    rows = [(rng.choice(["hot", rng.choice("abcdefgh"), rng.choice("abcdefgh")]), round(rng.choice([rng.uniform(0, 3 * 86400), rng.gauss(86400, 900)]), 3)) for _ in range(1500)]
    rows = [(c, abs(s)) for c, s in rows]
    policy = spark.createDataFrame([("n", limit, daily)], "namespace string, minute_limit int, daily_limit int")
    asked = requests(spark, rows).withColumn("namespace", F.lit("n"))
    got = {r.request_id: r.accepted for r in limiter.admit_by_policy(asked, policy, window).collect()}
    assert got == brute(rows, limit, daily, window)


def test_later_rounds_replay_only_runs_at_the_caps(spark, monkeypatch):
    """One client is busy around midnight after a full day; the busy runs of the other days are not replayed."""
    rows = [("a", 86400 * d + 40_000 + s) for d in range(6) for s in range(60)] + [("b", 86400 * d + 50_000 + s) for d in range(6) for s in range(60)]
    rows += [("m", 86400 - 30 + s) for s in range(60)]
    policy = spark.createDataFrame([("n", 3, 8)], "namespace string, minute_limit int, daily_limit int")
    asked = requests(spark, rows).withColumn("namespace", F.lit("n")).withColumn("minute_limit", F.lit(3))
    replayed, real = [], limiter._replayed
    monkeypatch.setattr(limiter, "_replayed", lambda placed, width: replayed.append(placed.where("_run is not null").count()) or real(placed, width))
    got = {r.request_id: r.accepted for r in limiter.admit_by_policy(asked.drop("minute_limit"), policy, 60).collect()}
    assert got == brute(rows, 3, 8, 60)
    assert len(replayed) >= 2 and sum(replayed[1:]) < replayed[0] / 3


def test_address_slot_is_spent(spark):
    rows = requests(spark, [("v", 0), ("v", 1), ("w", 2), ("w", 70)]).select("request_id", "ts", F.col("client").alias("visitor"), F.lit("ip").alias("ip"))
    got = {r.request_id: (r.ip_ok, r.accepted) for r in limiter.admit(rows, ip_limit=2, visitor_limit=1, daily_limit=9).collect()}
    assert got == {0: (True, True), 1: (True, False), 2: (False, False), 3: (True, True)}


def test_stream_limit_over_several_batches(spark, tmp_path):
    rng = random.Random(5)
    rows = sorted(((rng.choice("ab"), round(rng.uniform(0, 900), 3)) for _ in range(300)), key=lambda r: r[1])
    asked = requests(spark, rows).withColumn("namespace", F.lit("n")).withColumn("minute_limit", F.lit(3))
    for part in range(3):
        asked.where((F.col("request_id") >= part * 100) & (F.col("request_id") < part * 100 + 100)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(asked.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {r.request_id: r.accepted for r in runs.drain(stream_limiter.stream_limit(stream), "test").collect()}
    assert got == brute(rows, 3, None, 60)


def test_a_busy_client_in_one_micro_batch(spark, tmp_path):
    """One client sends nearly all requests of a batch, in no order; results leave in slices."""
    rng = random.Random(8)
    rows = [("hot" if k % 50 else "b", round(rng.uniform(0, 40_000), 3)) for k in range(120_000)]
    asked = requests(spark, rows).withColumn("namespace", F.lit("n")).withColumn("minute_limit", F.lit(3))
    asked.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(asked.schema).parquet(str(tmp_path / "in"))
    got = {r.request_id: r.accepted for r in runs.drain(stream_limiter.stream_limit(stream), "test").collect()}
    assert got == brute(rows, 3, None, 60)


def test_a_long_history_in_one_micro_batch(spark, tmp_path):
    """20,000 messages of one conversation at once: head and tail of the summary as if all lines had been joined."""
    messages = talk(spark, 20_000)
    messages.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(messages.schema).parquet(str(tmp_path / "in"))
    got = runs.drain(memory.stream_memory(stream, max_chars=1000), "test").first()
    state = spark.createDataFrame([(1, "", 0)], "conversation_id long, summary string, summarized_through_sequence int")
    rolled = cv.roll_summary(state, messages, max_chars=1000).first()
    assert got.summary == rolled.summary and len(got.summary) == 1000
    assert got.summarized_through_sequence == 19_992 and got.recent_sequences == list(range(19_993, 20_001))


def talk(spark, n, conversation=1):
    return spark.createDataFrame(
        [(conversation * 1000 + i, conversation, i, "user" if i % 2 else "assistant", f"m{i} words", "completed") for i in range(1, n + 1)], MESSAGE
    )


def test_memory_example(spark):
    messages = talk(spark, 10)
    state = spark.createDataFrame([(1, "", 0)], "conversation_id long, summary string, summarized_through_sequence int")
    assert sorted(r.sequence_no for r in cv.recent_memory(messages).collect()) == list(range(3, 11))
    rolled = cv.roll_summary(state, messages).first()
    assert rolled.summary == "用户：m1 words\n助手：m2 words" and rolled.summarized_through_sequence == 2
    assert [r.sequence_no for r in cv.recent_memory(messages, budget=9).orderBy("sequence_no").collect()] == [8, 9, 10]
    assert [r.sequence_no for r in cv.recent_memory(messages, budget=0).collect()] == [10]


def test_long_summary_keeps_head_and_tail(spark):
    text = "h" * 600 + "x" * 5000 + "t" * 3397
    got = spark.createDataFrame([(text,)], "s string").select(cv.clip_summary(F.col("s"))).first()[0]
    assert got == "h" * 600 + "\n…\n" + "t" * 3397 and len(got) == 4000


def test_stream_memory_equals_batch(spark, tmp_path):
    messages = talk(spark, 12).unionByName(talk(spark, 3, 2))
    for low, high in ((0, 5), (5, 9), (9, 99)):
        messages.where(F.col("sequence_no").between(low + 1, high)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(messages.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    final = runs.drain(memory.stream_memory(stream), "test").groupBy("conversation_id").agg(
        F.max_by(F.struct("summary", "summarized_through_sequence", "recent_sequences"), F.element_at("recent_sequences", -1)).alias("m")
    )
    got = {r.conversation_id: r.m for r in final.collect()}
    batch = {r.conversation_id: r.summary for r in cv.roll_summary(
        spark.createDataFrame([(1, "", 0), (2, "", 0)], "conversation_id long, summary string, summarized_through_sequence int"), messages
    ).collect()}
    assert {k: v.summary for k, v in got.items()} == batch
    assert list(got[1].recent_sequences) == list(range(5, 13)) and got[1].summarized_through_sequence == 4


def test_numbering_over_slices(spark):
    df = spark.range(1000).select(F.lit("hot").alias("k"), (F.col("id") * 7 % 1000).alias("v"))
    got = number_rows(df, ["k"], [F.asc("v")], F.floor(F.col("v") / 50), "n")
    assert got.where(F.col("n") != F.col("v") + 1).count() == 0 and got.count() == 1000


def test_feedback(spark):
    rows = [(1, 5, 1, None, None, START), (2, 5, -1, "信息错误", "c", START + timedelta(hours=1)), (3, None, 1, None, None, START), (4, None, 1, None, None, START)]
    df = spark.createDataFrame(rows, "feedback_id long, message_id long, rating int, reason string, comment string, created_at timestamp")
    assert {r.feedback_id for r in fb.dedupe_feedback(df).collect()} == {2, 3, 4}
    merged = fb.upsert_feedback(df.where("feedback_id = 1"), df.where("feedback_id = 2")).first()
    assert (merged.feedback_id, merged.rating, merged.reason) == (1, -1, "信息错误")
    checked = fb.check_feedback(df.withColumn("comment", F.lit("x" * 501)))
    assert checked.where("valid").count() == 0


def test_client_ip(spark):
    rows = [("10.0.0.1", " 1.2.3.4 "), ("10.0.0.1", "unknown"), ("9.9.9.9", "1.2.3.4"), ("10.0.0.1", None), ("unknown", "1.2.3.4"), ("fd00::1", "2001:DB8::1"), ("10.0.0.01", "1.2.3.4")]
    df = spark.createDataFrame(rows, "peer string, forwarded string")
    got = [r.client_ip for r in vs.resolve_client_ip(df, ["10.0.0.0/24", "fd00::/8"], ipv6=True).collect()]
    assert got == ["1.2.3.4", "10.0.0.1", "9.9.9.9", "10.0.0.1", "unknown", "2001:db8::1", "10.0.0.01"]


def test_paging(spark):
    page = cv.message_page(talk(spark, 10), 3, before=9)
    assert [(r.sequence_no, r.has_more) for r in page.orderBy("sequence_no").collect()] == [(6, True), (7, True), (8, True)]
    assert not cv.message_page(talk(spark, 3), 3).first().has_more


def test_stream_ingest_adds_and_changes(spark, tmp_path):
    entities = spark.createDataFrame([(1, "none")], "entity_id long, slug string")
    for n, rows in enumerate(([("knowledge/a.md", "alpha " * 20)], [("knowledge/a.md", "beta " * 20), ("knowledge/b.md", "gamma " * 20)])):
        spark.createDataFrame(rows, "source_id string, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("source_id string, text string").parquet(str(tmp_path / "in"))
        stream_ingest(stream, entities, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    _, chunks, version = stored(spark, str(tmp_path / "out"))
    assert version == 3 and sorted(r.content.split()[0] for r in chunks.collect()) == ["beta", "gamma"]


def test_no_message_is_left_out_of_long_histories(spark):
    messages = talk(spark, 1300)
    state = spark.createDataFrame([(1, "", 0)], "conversation_id long, summary string, summarized_through_sequence int")
    assert cv.unsummarized(state, messages).count() == 1292
    lines = [f"{'用户' if i % 2 else '助手'}：m{i} words" for i in range(1, 1293)]
    whole = cv.roll_summary(state, messages, max_chars=10**6).first()
    assert whole.summary == "\n".join(lines) and whole.summarized_through_sequence == 1292
    short = cv.roll_summary(state, messages, max_chars=1000).first()
    text = "\n".join(lines)
    assert short.summary == text[:600] + "\n…\n" + text[-397:] and short.summarized_through_sequence == 1292
    none = spark.createDataFrame([], "message_id long, rating int, reason string, comment string")
    assert cv.transcript_with_feedback(messages, none).count() == 1300
    assert cv.transcript_with_feedback(messages, none, limit=7).count() == 7


def test_requests_without_a_policy_are_marked(spark):
    rows = requests(spark, [("a", 1.0), ("a", 2.0)])
    asked = rows.withColumn("namespace", F.when(F.col("request_id") == 0, "known").otherwise("other"))
    policy = spark.createDataFrame([("known", 5, None)], "namespace string, minute_limit int, daily_limit int")
    got = {r.request_id: r.accepted for r in limiter.admit_by_policy(asked, policy).collect()}
    assert got == {0: True, 1: None}


def test_compacted_batches_are_not_read_again(spark, tmp_path):
    root = str(tmp_path / "t")

    def add(number, rows):
        spark.createDataFrame(rows, "k int, v int").write.parquet(f"{root}/delta/batch={number}")

    add(0, [(1, 1), (2, 1)])
    add(1, [(2, 2)])
    compact(spark, root, ["k"], ["v"])
    add(2, [(3, 1), (1, 5)])
    got = read_latest(spark, root, ["k"], ["v"])
    assert sorted(map(tuple, got.select("k", "v").collect())) == [(1, 5), (2, 2), (3, 1)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*batch#\d+L? > 1\)", plan)  # folders up to batch 1 are not listed
    compact(spark, root, ["k"], ["v"])
    assert read_latest(spark, root, ["k"], ["v"]).count() == 3
