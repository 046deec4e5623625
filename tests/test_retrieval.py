import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from driver_queries.tables import chunks, general_plans, general_targets, questions
from evidentia.operators import candidates as find, evidence as ev, fusion, routing
from evidentia.operators.substring_join import substring_join
from evidentia.plans.answer import route_answers as plan_answers
from evidentia.plans.retrieval import retrieve

CHUNK = "chunk_id long, document_id long, project_id long, title string, section string, content string, tags array<string>, embedding array<float>, visibility string, confidence string"


def corpus(spark, rows):
    return spark.createDataFrame([(*r, "public", "confirmed") for r in rows], CHUNK)


def targets(spark, rows, k=10):
    schema = "target_id string, query string, embedding array<float>, fetch_k int"
    return spark.createDataFrame([(t, q, v, k) for t, q, v in rows], schema)


def brute_cosine(a, b):
    return float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))


@pytest.mark.parametrize("broadcast_rows", [1000, 4])
def test_vector_topk_equals_brute_force(spark, broadcast_rows):
    rng = random.Random(1)
    vec = lambda: [round(rng.uniform(-1, 1), 2) for _ in range(4)]
    rows = [(i, i, None, "t", "s", "c", [], vec() if i % 7 else None) for i in range(300)]
    rows.append((999, 1, None, "t", "s", "c", [], [0.0] * 4))
    asked = [(f"q{i}", "x", vec()) for i in range(9)]
    got = find.vector_topk(
        targets(spark, asked, 5), corpus(spark, rows).repartition(5), max_k=5,
        max_broadcast_rows=broadcast_rows, rows_per_block=16, targets_per_block=4,
    )
    # The corpus is scored where it lies, also when the questions come in slices.
    assert "Exchange hashpartitioning(scan" not in got._jdf.queryExecution().executedPlan().toString()
    got = got.collect()
    for name, _, q in asked:
        best = sorted((-round(brute_cosine(np.float32(q), np.float32(r[7])), 9), r[0]) for r in rows if r[7] and any(r[7]))[:5]
        ours = sorted((r.rank, r.chunk_id) for r in got if r.target_id == name)
        assert [c for _, c in ours] == [c for _, c in best]


def lexical_brute(terms, rows, allowed=lambda r: True):
    """``[(-score, chunk)]`` of one target, best first."""
    like = lambda t: "".join("." if ch == "_" else re.escape(ch) for ch in t)
    scores = []
    for r in rows:
        fields = ((2.0, r[3]), (1.5, r[4] or ""), (1.0, r[5]))
        raw = sum(w for t in terms for w, field in fields if re.search(like(t), field.lower(), re.S))
        if raw and allowed(r):
            scores.append((-raw, r[0]))
    return sorted(scores)


def best_of(got, name, number=1):
    return [(-r.raw_score, r.chunk_id) for r in sorted(got, key=lambda r: r.rank) if r.target_id == name and r.pass_no == number]


@pytest.mark.parametrize("terms_per_scan,small", [(100_000, True), (2, False)])
def test_lexical_topk_equals_brute_force(spark, terms_per_scan, small, monkeypatch):
    rng = random.Random(2)
    words = ["storage", "rag", "data_keeper", "dataXkeeper", "RAGs", "a-b", "项目背景", "技术", "été", "keeper"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, i, None, text(2), rng.choice(["技术", "rag", None]), text(6), [], [1.0]) for i in range(80)]
    asked = [("q1", "what is RAG", [1.0]), ("q2", "data_keeper 的技术背景", [1.0]), ("q3", "。", [1.0])]
    if not small:
        met = find._met
        monkeypatch.setattr(find, "_met", lambda lists, wanted, few: met(lists, wanted, False))
        monkeypatch.setattr(find, "broadcast_if_small", lambda df, n=0: df)
    got = find.lexical_topk(targets(spark, asked, 50), corpus(spark, rows), max_k=50, terms_per_scan=terms_per_scan).collect()
    terms = {r.target_id: r.terms for r in find.question_terms(targets(spark, asked)).collect()}
    for name, _, _ in asked:
        assert best_of(got, name) == lexical_brute(terms[name], rows)[:50]


@pytest.mark.parametrize("heavy", [4, 0, 10**9])
def test_heavy_terms_wait_without_changing_the_result(spark, heavy, monkeypatch):
    """A term of nearly every chunk beside rare ones; targets with filters, over all passes."""
    rng = random.Random(9)
    monkeypatch.setattr(find, "_HEAVY", heavy)
    monkeypatch.setattr(find, "_WORTH_WAITING", 0)
    common = ["commonplace", "everywhere"]
    rare = [f"rare{k}x" for k in range(8)]
    rows = []
    for i in range(400):
        content = " ".join(rng.sample(common, rng.choice([0, 1, 2, 2])) + rng.sample(rare, rng.choice([0, 0, 0, 1, 3])))
        rows.append((i, i, i % 3, rng.choice(["rare1x rare2x", "note", "everywhere"]), rng.choice(["alpha", "beta", None]), content, [], None))
    queries = [("a", "commonplace rare0x rare1x rare2x", None, None), ("b", "everywhere commonplace", 1, ["ALP"]), ("c", "rare3x everywhere", 2, []), ("d", "rare4x rare5x rare6x", None, ["bet"])]
    asked = spark.createDataFrame(
        [(t, q, None, 5, p, s) for t, q, p, s in queries],
        "target_id string, query string, embedding array<float>, fetch_k int, project_id long, section_terms array<string>",
    )
    got = find.lexical_topk(asked, corpus(spark, rows), max_k=5, passes=find.PASSES).collect()
    terms = {r.target_id: r.terms for r in find.question_terms(asked).collect()}
    for name, _, project, sections in queries:
        in_project = lambda r: project is None or r[2] == project
        in_section = lambda r: not sections or any(t.lower() in (r[4] or "").lower() for t in sections)
        wanted = {1: lambda r: in_project(r) and in_section(r)}
        if sections:
            wanted[2] = in_project
        if project is not None:
            wanted[3] = in_section
        for number in (1, 2, 3):
            expected = lexical_brute(terms[name], rows, wanted[number])[:5] if number in wanted else []
            assert best_of(got, name, number) == expected, (name, number)


def test_full_hit_scores_one(spark):
    rows = [(1, 1, None, "rag", "rag", "rag", [], None)]
    got = find.lexical_topk(targets(spark, [("q", "rag", None)]), corpus(spark, rows), max_k=10).first()
    assert got.raw_score == 4.5 and got.lexical_score == 1.0


@pytest.mark.parametrize("limit", [50_000, 0])
def test_substring_join_equals_brute_force(spark, limit):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab一c ") for _ in range(rng.randrange(0, 30))) for _ in range(60)]
    phrases = ["", "a", "ab", "一c", "abab", "c a一", "zzz"]
    left = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    right = spark.createDataFrame([(p,) for p in phrases], "p string")
    got = {(r.i, r.p) for r in substring_join(left, "t", right, "p", max_broadcast_rows=limit).collect()}
    assert got == {(i, p) for i, t in enumerate(texts) for p in phrases if p in t}


def test_diversity_cap_and_order(spark):
    rows = [("t", 1, 1, 10, 0.9, 1, None), ("t", 1, 2, 10, 0.8, 2, None), ("t", 1, 3, 10, 0.7, 3, None), ("t", 1, 4, 20, 0.6, 4, None), ("t", 1, 5, None, 0.5, None, 1), ("t", 1, 6, None, 0.5, None, 2), ("t", 1, 7, None, 0.5, None, 3)]
    ranked = spark.createDataFrame(rows, "target_id string, pass_no int, chunk_id long, document_id long, score double, vector_rank int, lexical_rank int").withColumn("k", F.lit(10))
    kept = fusion.topk_per_target(fusion.cap_per_document(ranked)).orderBy("position").collect()
    assert [r.chunk_id for r in kept] == [1, 2, 4, 5, 6, 7]


def test_scores_and_threshold(spark):
    df = spark.createDataFrame([(0.92, 0.0, 1, None), (0.58, 0.0, 2, 2), (0.2, 1.0, None, 1)], "v double, l double, vr int, lr int")
    base = fusion.base_score(F.col("v"), F.col("l"))
    got = [r.s for r in df.select(fusion.rrf_bonus(base, F.col("vr"), F.col("lr")).alias("s")).collect()]
    assert got[0] == pytest.approx(0.92) and got[1] == pytest.approx(0.58 + 0.04 * 61 / 62) and got[2] == pytest.approx(0.85)


def test_empty_inputs(spark, sf):
    asked, docs = questions(spark, sf), chunks(spark, sf)
    for a, c in ((asked.where("false"), docs), (asked, docs.where("false"))):
        evidence, missing = retrieve(general_plans(a), general_targets(a), c)
        assert evidence.count() == 0 and missing.count() == a.count()


def entities(spark, n=4):
    names = ["仓储平台", "分拣助手", "文档问答", "旅行日记"][:n]
    return spark.createDataFrame([(i, f"p{i}", t, i) for i, t in enumerate(names)], "entity_id long, slug string, title string, sort_order int")


def route(spark, asked, n=4):
    q = spark.createDataFrame([(i, t) for i, t in enumerate(asked)], "question_id long, question string")
    aliases = spark.createDataFrame([("p1", "分拣"), ("p3", "data keeper"), ("gone", "此处")], "slug string, alias string")
    domains = spark.createDataFrame([("技能", "技术栈", 0), ("优势", "优势", 1), ("不足", "短板", 2)], "label string, alias string, sort_order int")
    plans = routing.route_questions(q, entities(spark, n), aliases, domains)
    return plans, {r.question_id: r for r in plans.collect()}


def test_routing(spark):
    lists = ["列出项目", "都有哪些项目", "做过几个项目，名称是什么", "作品清单", "Project 有多少"]
    asked = lists + [
        "所有项目的背景、职责和技术分别是什么", "分拣和 DataKeeper 的区别", "分拣的技术", "技术栈和优势", "学校在哪里；做什么工作；住在什么地方", "你好吗", "此处是什么",
    ]
    plans, got = route(spark, asked)
    assert all(got[i].intent == "project_list" and got[i].context_limit == 5 for i in range(5))
    assert got[5].intent == "multi_project" and len(got[5].expected_coverage) == 12 and got[5].context_limit == 12
    assert got[6].intent == "multi_project" and [e.slug for e in got[6].entities] == ["p1", "p3"]
    assert got[7].intent == "single_project" and got[7].expected_coverage == ["分拣助手/技术方案"] and got[7].context_limit == 5
    assert not got[7].requires_coverage
    assert got[8].intent == "multi_part" and got[8].parts == ["技能", "优势"]
    assert got[9].intent == "multi_part" and len(got[9].parts) == 3 and got[9].context_limit == 6
    assert got[10].intent == "general" and got[11].intent == "general"
    targets = routing.expand_targets(plans).where("question_id = 7").collect()
    assert targets[0].query == "分拣助手：技术栈 架构 技术方案 实现" and targets[0].project_slug == "p1"


def test_list_answer(spark):
    plans, _ = route(spark, ["列出项目"])
    assert routing.list_answer(plans, entities(spark)).first().content == "1. 仓储平台\n2. 分拣助手\n3. 文档问答\n4. 旅行日记"
    assert routing.list_answer(plans, entities(spark).where("false")).first().content == "当前没有公开项目。"


def test_missing_coverage(spark):
    plans = spark.createDataFrame([(1, ["a/x", "b/x", "b/y"])], "question_id long, expected_coverage array<string>")
    evidence = spark.createDataFrame([(1, ["a/x"])], "question_id long, coverage_keys array<string>")
    assert fusion.missing_coverage(evidence, plans).first().missing == ["b/x", "b/y"]


def test_gates(spark):
    q = spark.createDataFrame(
        [(1, "a"), (2, "b"), (3, "实习多久"), (4, "绩点多少"), (5, "独立完成的？"), (6, "实习")], "question_id long, question string"
    )
    schema = "question_id long, chunk_id string, title string, section string, content string, tags array<string>, score double, rank int"
    evidence = spark.createDataFrame(
        [(2, "c", "t", "s", "x", [], 0.3, 1), (3, "c", "t", "s", "x", [], 0.9, 1), (4, "c", "t", "s", "none", [], 0.9, 1),
         (5, "c", "t", "职责", "x", [], 0.9, 1), (6, "c", "t", "s", "x", ["experience"], 0.9, 1)], schema,
    )
    got = {r.question_id: r.sufficient for r in ev.evidence_gates(q, evidence).collect()}
    assert got == {1: False, 2: False, 3: False, 4: False, 5: True, 6: True}


def test_alias_title_boost(spark):
    asked = spark.createDataFrame([("t1", "介绍甲乙"), ("t2", "hello")], "target_id string, query string")
    names = spark.createDataFrame([("分拣平台", "甲乙")], "canonical string, alias string")
    joined = asked.join(fusion.mentioned_names(asked, names), "target_id", "left")
    boost = fusion.title_boost(F.lit("关于 分拣平台 的说明"), F.col("query"), F.col("mentioned"))
    assert {r.target_id: r.b for r in joined.select("target_id", boost.alias("b")).collect()} == {"t1": 0.1, "t2": 0.0}


def test_citations_are_redacted(spark):
    schema = "question_id long, chunk_id string, title string, section string, content string, tags array<string>, score double, rank int"
    evidence = spark.createDataFrame([(1, "c", "t", "s", "password = abcdefghijklmnop1234 and more", [], 0.9, 1)], schema)
    assert "abcdefghijklmnop" not in ev.format_citations(evidence).first().content_preview


def test_list_questions_go_through_the_gates(spark):
    schema = "question_id long, question string, intent string, expected_coverage array<string>, context_limit int"
    plan = spark.createDataFrame([(1, "列出项目", routing.LIST, [], 5), (2, "独立完成的项目列出", routing.LIST, [], 5), (3, "", "general", [], 5)], schema)
    none = spark.createDataFrame([], "question_id long, chunk_id string, title string, section string, content string, tags array<string>, score double, rank int")
    missing = spark.createDataFrame([], "question_id long, missing array<string>")
    known = spark.createDataFrame([], "faq_order int, title string, answer string")
    got = {r.question_id: r for r in plan_answers(plan, none, missing, known, entities(spark), list_lead="{n}:").collect()}
    assert got[1].route == "list" and got[1].answer.startswith("4:\n\n1. ") and got[1].citations[0].id == "catalogue"
    assert got[2].route == "insufficient" and got[2].citations is None
    assert got[3].route == "empty"


def test_corpus_predicate_by_entity_and_section(spark):
    rows = [(1, "public", "confirmed", 5, "Main > Duties"), (2, "public", "confirmed", 6, "duties"), (3, "public", "confirmed", 5, None),
            (4, "private", "confirmed", 5, "duties"), (5, "public", "unverified", 5, "duties")]
    chunks = spark.createDataFrame(rows, "chunk_id long, visibility string, confidence string, project_id long, section string")
    kept = lambda **options: sorted(r.chunk_id for r in find.filter_chunks(chunks, **options).collect())
    assert kept() == [1, 2, 3] and kept(project_ids=[5]) == [1, 3]
    assert kept(section_terms=["DUT"]) == [1, 2] and kept(project_ids=[5], section_terms=["dut", "none"]) == [1]
    assert kept(confidence=None) == [1, 2, 3, 5]
