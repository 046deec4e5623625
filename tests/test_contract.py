import re

import pytest

import __spark_entry__ as entry

SQL_FREE = {"sanitize_pages", "route_answers"}


def test_every_query_has_an_oracle_or_a_reason():
    # The training-data operators, which can be taken out, say for themselves why they have none.
    own = {name for name in entry.queries() if not re.fullmatch(r"op\d+_.*|pipeline", name)}
    assert own - set(entry.oracle_sql()) == SQL_FREE
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    result = entry.entry(spark)
    assert result.columns == ["question_id", "chunk_id", "score", "rank"] and result.count() > 0


@pytest.mark.parametrize(
    "name", ["entity_mentions", "match_domains", "match_faq", "search_conversations", "resolve_client_ip", "lexical_topk", "vector_topk", "title_boost"]
)
def test_no_nested_loops(spark, sf, name):
    plan = entry.queries()[name](spark, sf)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_static_filters_reach_the_scan(spark, tmp_path):
    from evidentia.operators.candidates import filter_chunks

    path = str(tmp_path / "chunks")
    spark.range(10).selectExpr("id", "'public' visibility", "'confirmed' confidence", "'s' section", "'c' content").write.parquet(path)
    plan = filter_chunks(spark.read.parquet(path)).select("id")._jdf.queryExecution().toString()
    assert "EqualTo(visibility,public)" in plan and "In(confidence" in plan and "content" not in plan.split("ReadSchema")[-1].split("\n")[0]


def test_newest_n_is_cut_before_the_shuffle(spark, sf):
    plan = entry.queries()["recent_memory"](spark, sf)._jdf.queryExecution().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_lists_aggregate_only_messages_of_listed_conversations(spark, sf):
    """The semi-join stands below the aggregation of the messages."""
    for name in ("list_owned", "list_admin"):
        plan = entry.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        lines = plan.split("\n")
        semi = next(i for i, line in enumerate(lines) if "Join LeftSemi" in line)
        assert any("Aggregate [conversation_id" in line for line in lines[:semi]), name


def test_no_answer_meets_the_questions(spark):
    from evidentia.operators.faq import match_faq

    faq = spark.createDataFrame([(1, "what is this about", "a long answer")], "faq_order int, title string, answer string")
    asked = spark.createDataFrame([(1, "What is this about?"), (2, "so tell me what is this about now")], "question_id long, question string")
    found = match_faq(asked, faq)
    assert {(r.question_id, r.answer) for r in found.collect()} == {(1, "a long answer"), (2, "a long answer")}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("answer#") and all("answer#" not in line for line in plan.split("\n") if "Contains" in line or "StartsWith" in line)
