"""Inputs laid out as large tables are, and steps whose work has to follow the input."""

from __future__ import annotations

import hashlib
import random
import time

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from driver_queries import questions, streams
from evidentia.functions.text import normalize_key
from evidentia.operators import fusion, listing, routing
from evidentia.session import prepare
from evidentia.streaming.memory import StaleAnswers


def test_streams_read_tables_that_are_folders(spark, tmp_path):
    turns = spark.range(40).select(
        F.floor(F.col("id") / 4).alias("conv_id"), (F.col("id") % 4).alias("turn"),
        F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"),
    )
    turns.repartition(3).write.parquet(str(tmp_path / "folder" / "conversations.parquet"))
    (tmp_path / "file").mkdir()
    turns.toPandas().to_parquet(tmp_path / "file" / "conversations.parquet", index=False)
    for layout in ("folder", "file"):
        sf = str(tmp_path / layout)
        for name, count in (("stream_rollup", 10), ("stream_memory", 10), ("stream_dedupe", 20)):
            assert streams.QUERIES[name](spark, sf).count() == count, (layout, name)


class _Held:
    """A value state, the timers of one key, and the times they tell."""

    def __init__(self):
        self.value, self.timers, self.now = None, set(), 0

    def getValueState(self, *_):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)

    def getCurrentWatermarkInMs(self):
        return self.now

    def getExpiryTimeInMs(self):
        return self.now


def test_one_call_serves_many_stale_answers():
    chance, held, told, open_answers, wanted = random.Random(5), _Held(), [], {}, []
    processor = StaleAnswers(100)
    processor.init(held)
    for step in range(30):
        events = [(chance.randrange(40), chance.choice(("started", "finished")), step * 60 + chance.randrange(90)) for _ in range(25)]
        parts = [pd.DataFrame(events[:9], columns=["generation_id", "phase", "ts_ms"]), pd.DataFrame(events[9:], columns=["generation_id", "phase", "ts_ms"])]
        told += [part for part in processor.handleInputRows((3,), iter(parts), held)]
        for answer, phase, at in sorted(events, key=lambda e: (e[2], e[1] == "finished")):
            if phase == "started":
                open_answers[answer] = at
            elif answer in open_answers and at - open_answers[answer] <= 100:
                del open_answers[answer]
        held.now = step * 60
        while due := [at for at in held.timers if at <= held.now]:
            held.timers.remove(min(due))
            told += [part for part in processor.handleExpiredTimer((3,), held, held)]
        for answer, at in sorted(open_answers.items()):
            if at + 100 <= held.now:
                wanted.append((answer, at))
                del open_answers[answer]
        assert len(held.timers) <= 1
    found = [row for part in told for row in part[["generation_id", "started_ms"]].itertuples(index=False, name=None)]
    assert len(wanted) > 50 and sorted(found) == sorted(wanted)


def test_title_boost_normalises_a_title_once(spark):
    """Compared with a plain count over pairs; the plan of a pair holds no normalisation when the key is given."""
    rows = [("Grand Hôtel Nord", "über nord", ["nord"]), ("Süd", "nord süd", ["nord"]), (None, "x", [""]), ("项目经验", "项目经验好", None), ("项目", "经验", [])]
    pairs = spark.createDataFrame(rows, "title string, query string, mentioned array<string>")
    keyed = pairs.withColumn("key", normalize_key(F.coalesce("title", F.lit(""))))
    plain = fusion.title_boost(F.col("title"), F.col("query"), F.col("mentioned"))
    given = fusion.title_boost(F.col("title"), F.col("query"), F.col("mentioned"), c_key=F.col("key"))
    found = keyed.select((plain > 0).alias("plain"), (given > 0).alias("given")).collect()
    assert [tuple(r) for r in found] == [(True, True), (False, False), (True, True), (True, True), (False, False)]


def test_title_boost_pairs_only_keys_before_texts(spark, tmp_path):
    """Titles follow for distinct pairs: no row that is shuffled for a (title, name) match carries the title."""
    words = "alpha beta gamma delta epsilon zeta".split()
    spark.createDataFrame([(n, " ".join(words[n % 3:] + words)) for n in range(12)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    documents = [(n, f"{words[n % 6]} of {words[n % 4]} {n}\nrest") for n in range(30)] + [(29, "eps"), (None, "beta"), (None, None)]
    spark.createDataFrame(documents, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = [tuple(r) for r in questions.QUERIES["title_boost"](spark, str(tmp_path)).select("item_id", "doc_id").collect()]
    passages = {n: words[n % 3:] + words for n in range(12)}
    canonical = [(p[1], p[5]) for p in passages.values()]
    wanted = [
        (n, doc) for n, p in passages.items() for doc, text in documents
        if text is not None and any(alias in "".join(p) and name in text.split("\n")[0].replace(" ", "") for name, alias in canonical)
    ]
    assert len(wanted) > 50 and sorted(found, key=str) == sorted(wanted, key=str)


def test_every_text_is_written_to_a_file_by_its_task(spark, tmp_path):
    texts = [("a\nb",), ("",), (None,), ("é",)] * 5
    streams._write_one_each(spark.createDataFrame(texts, "value string").repartition(3), str(tmp_path / "docs"))
    written = sorted(path.read_bytes() for path in (tmp_path / "docs").rglob("*.txt"))
    assert written == sorted(((t or "") + "\n").encode() for (t,) in texts)
    assert not [path for path in (tmp_path / "docs").rglob("*") if path.is_file() and path.suffix != ".txt"]


def test_the_listing_is_shown_once_for_all_questions(spark):
    plans = spark.range(50).select(F.col("id").alias("question_id"), F.lit(routing.LIST).alias("intent"))
    catalogue = spark.createDataFrame([(1, 7, "x"), (0, 8, "y")], "sort_order int, entity_id long, title string")
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def shown(text):
        calls.add(1)
        return f"<{text}>"

    found = {r.content for r in routing.list_answer(plans, catalogue, shown=shown).collect()}
    assert found == {"<1. y\n2. x>"} and calls.value <= 2


def test_no_task_holds_the_text_of_a_long_listing(spark, tmp_path):
    """list_answer sorts, numbers and digests parts in pieces; the same text as from one row, nulls and equal rows included."""
    parts = [(n % 7919 if n % 97 else None, f"name {n % 13}" if n % 11 else None, "SMALL" if n % 6 == 0 else "LARGE", n * 7 % 50 if n % 89 else None) for n in range(25_000)]
    schema = "p_partkey long, p_name string, p_type string, p_size int"
    spark.createDataFrame(parts, schema).repartition(5).write.parquet(str(tmp_path / "part.parquet"))
    spark.createDataFrame([(1, "an odd passage of plain words"), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    turns = [(1, 0, "user", "what motion"), (2, 0, "user", "plain"), (3, 0, "assistant", "what motion"), (1, 0, "user", "which nation")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))

    first = lambda c: (c is not None, c if c is not None else 0)
    public = sorted(((size, key, name) for key, name, kind, size in parts if kind != "SMALL"), key=lambda r: (first(r[0]), first(r[1]), (r[2] is not None, r[2] or "")))
    text = "\n".join(f"{k}. {name}" if name is not None else str(k) for k, (_, _, name) in enumerate(public, 1))
    found = questions.QUERIES["list_answer"](spark, str(tmp_path))
    assert [tuple(r) for r in found.collect()] == [(1000, hashlib.md5(text.encode()).hexdigest(), 1.0)] * 2
    assert "array_join" not in found._jdf.queryExecution().optimizedPlan().toString()

    catalogue = spark.createDataFrame(public, "sort_order int, entity_id long, title string").repartition(4)
    pieces, n = listing.numbered_lines(catalogue, ["sort_order", "entity_id", "title"], "title")
    lengths = [r.lines.count(b"\n") + 1 for r in pieces.collect()]
    assert n == sum(lengths) == len(public) and len(lengths) > 1 and max(lengths) <= 10_000
    plans = spark.createDataFrame([(5, routing.LIST), (6, routing.GENERAL)], "question_id long, intent string")
    assert [(r.question_id, r.content, r.n) for r in routing.list_answer(plans, catalogue).collect()] == [(5, text, n)]
    empty = routing.list_answer(plans, catalogue.where("false"), "none", digest="md5").collect()
    assert [(r.content, r.n) for r in empty] == [(hashlib.md5(b"none").hexdigest(), 0)]


def test_python_workers_get_batches_cut_by_bytes(spark):
    texts = prepare(spark).range(4_000, numPartitions=1).select(F.repeat(F.lit("x"), 20_000).alias("text"))
    longest = texts.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"]) for b in batches), "n long")
    assert longest.agg(F.max("n")).first()[0] < 12 << 20


def test_a_file_reference_is_found_in_linear_time(spark):
    from evidentia import fixed_values as fixed
    from evidentia.functions.safety import classify_safety

    rng = random.Random(5)
    texts = ["".join(rng.choice("a9É_-./\\ ,zZ") for _ in range(rng.randrange(0, 9))) for _ in range(400)] + [f"x.{'a' * n}" for n in range(15)]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select(
        F.rlike("t", F.lit(f"(?i){fixed.FILE_REFERENCE_PATTERN}")).alias("whole"), F.rlike("t", F.lit(f"(?i){fixed.FILE_REFERENCE_SIGN}")).alias("sign")
    )
    assert found.where("whole <> sign").count() == 0
    start = time.time()
    long = spark.createDataFrame([("展示" + "a" * 200_000,)], "t string")
    assert long.select(classify_safety(F.col("t"))).first()[0] == "safe"
    assert time.time() - start < 20  # 200,000 starts of a run of as many letters


def test_texts_do_not_travel_with_their_anchors(spark):
    """Only numbers and hashes meet in the join of many phrases, and a task holds no wide anchors."""
    from evidentia.operators.substring_join import substring_join

    texts = spark.createDataFrame([(i, f"{i} " + "abc " * 40) for i in range(50)], "i int, t string")
    phrases = spark.createDataFrame([(f"{i} abc",) for i in range(60)] + [(None,)], "p string")
    for few in (True, False):
        plan = substring_join(texts, "t", phrases, "p", max_broadcast_rows=1000 if few else 0)
        assert {(r.i, r.p) for r in plan.collect()} == {(i, f"{j} abc") for i in range(50) for j in range(60) if f"{j} abc" in f"{i} " + "abc " * 40}
        text = plan._jdf.queryExecution().optimizedPlan().toString()
        assert all(" t#" not in line for line in text.split("\n") if "Generate" in line)


def test_a_long_text_meets_many_phrases(spark, monkeypatch):
    from evidentia.operators import substring_join as sj

    monkeypatch.setattr(sj, "_FEW_TEXTS", 0)  # the shuffled join
    rng = random.Random(7)
    texts = ["".join(rng.choice("ab") for _ in range(300)) for _ in range(20)]
    phrases = sorted({t[a : a + n] for t in texts for n in (1, 2, 3, 7, 8, 9, 63, 64, 65, 200) for a in (0, 50)}) + ["c" * 70, ""]
    left, right = spark.createDataFrame(list(enumerate(texts)), "i int, t string"), spark.createDataFrame([(p,) for p in phrases], "p string")
    found = sj.substring_join(left, "t", right, "p", max_broadcast_rows=0, key="i")
    assert found.columns == ["i", "p"]
    assert sorted(map(tuple, found.collect())) == sorted((i, p) for i, t in enumerate(texts) for p in phrases if p in t)


def test_questions_of_one_compact_form_meet_the_titles_once(spark):
    from evidentia.operators.faq import match_faq

    known = spark.createDataFrame([(2, "how large is it"), (1, "How large is it now"), (3, "?!"), (4, "short")], "faq_order int, title string").withColumn("answer", F.lit("x"))
    asked = [(1, "how large is it"), (2, "HOW, large is it?"), (3, "how   large is it"), (4, None), (5, "so short"), (6, "tell me how large is it now"), (1, "unknown"), (None, "how large is it")]
    found = match_faq(spark.createDataFrame(asked, "question_id int, question string"), known).collect()
    assert {(r.question_id, r.faq_title) for r in found} == {
        (1, "how large is it"), (2, "How large is it now"), (3, "how large is it"), (6, "How large is it now"), (None, "how large is it")
    }


def test_sums_of_lists_are_made_in_bounded_tasks(spark, monkeypatch):
    from evidentia.operators import candidates as find

    corpus = spark.createDataFrame([(i, "t", "s", f"alpha beta {'gamma' if i % 5 == 0 else ''}") for i in range(100)], "chunk_id long, title string, section string, content string")
    asked = spark.createDataFrame([(k, "alpha beta gamma", 3) for k in range(10)], "target_id int, query string, fetch_k int")
    parts = []
    real = find._sums
    monkeypatch.setattr(find, "_PAIRS_PER_TASK", 50)
    monkeypatch.setattr(find, "_HEAVY", 1_000)
    monkeypatch.setattr(find, "_sums", lambda met: parts.append((met.rdd.getNumPartitions(), max(map(len, met.rdd.glom().collect())))) or real(met))
    found = find.lexical_topk(asked, corpus, max_k=3).collect()
    assert sorted((r.target_id, r.chunk_id, r["rank"]) for r in found) == [(k, 5 * n, n + 1) for k in range(10) for n in range(3)]
    assert parts[0][0] >= 2200 // 50 and parts[0][1] <= 400
