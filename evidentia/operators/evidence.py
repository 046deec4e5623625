"""Evidence gates, citations, and prompt context, one row per question."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from evidentia import fixed_values as fixed
from evidentia.functions.safety import hide_internal_references, redact_sensitive

#: Between the parts of a nested section's name.
SECTION_BREAK = " > "


def evidence_gates(
    questions: DataFrame,
    evidence: DataFrame,
    min_score: float = 0.40,
    numeric_pattern: str = fixed.NUMERIC_PATTERN,
    lead_pattern: str = fixed.LEAD_PATTERN,
    lead_sections: Sequence[str] = fixed.LEAD_SECTIONS,
    topic_word: str = fixed.TOPIC_WORD,
    topic_tag: str = fixed.TOPIC_TAG,
    match_last_segment: bool = False,
) -> DataFrame:
    """Whether each question's evidence suffices, with the verdict of every gate.

    One pass over the evidence, pre-aggregated per question before the shuffle. With
    ``match_last_segment`` a lead section may be the last part of a nested one (``main > duties``).
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    section = F.lower(text("section"))
    if match_last_segment:
        section = F.trim(F.substring_index(section, SECTION_BREAK, -1))
    facts = evidence.groupBy("question_id").agg(
        F.max("score").alias("top_score"),
        F.bool_or(F.rlike(text("content"), F.lit(r"\p{Nd}"))).alias("has_number"),
        F.bool_or(section.isin(*lead_sections)).alias("has_lead"),
        F.bool_or(
            F.array_contains(F.coalesce("tags", F.array().cast("array<string>")), topic_tag)
            | F.contains(F.concat_ws(" ", text("title"), text("section"), text("content")), F.lit(topic_word))
        ).alias("has_topic"),
    )
    q = F.col("question")
    false = F.lit(False)
    gates = questions.select("question_id", "question").join(facts, "question_id", "left").select(
        "question_id",
        F.coalesce(F.col("top_score") >= min_score, false).alias("score_ok"),
        (~F.rlike(q, F.lit(numeric_pattern)) | F.coalesce("has_number", false)).alias("numeric_ok"),
        (~F.rlike(q, F.lit(lead_pattern)) | F.coalesce("has_lead", false)).alias("lead_ok"),
        (~F.contains(q, F.lit(topic_word)) | F.coalesce("has_topic", false)).alias("topic_ok"),
    )
    return gates.withColumn(
        "sufficient", F.col("score_ok") & F.col("numeric_ok") & F.col("lead_ok") & F.col("topic_ok")
    )


def format_citations(evidence: DataFrame, preview: int = 150) -> DataFrame:
    """Evidence as shown to readers: secrets redacted, internal references hidden, content shortened."""
    optional = {
        "project_slug": F.lit(None).cast("string"),
        "coverage_keys": F.array().cast("array<string>"),
    }
    for name, default in optional.items():
        if name not in evidence.columns:
            evidence = evidence.withColumn(name, default)
    return evidence.select(
        "question_id", "rank",
        F.col("chunk_id").alias("id"),
        hide_internal_references(F.col("title")).alias("title"),
        "section",
        hide_internal_references(F.substring(redact_sensitive(F.coalesce("content", F.lit(""))), 1, preview)).alias("content_preview"),
        "project_slug",
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
        F.col("score").alias("ranking_score"),
    )


def citations_per_question(citations: DataFrame) -> DataFrame:
    fields = [c for c in citations.columns if c not in ("question_id",)]
    return citations.groupBy("question_id").agg(
        F.array_sort(F.collect_list(F.struct(*fields))).alias("citations")
    )


def build_context(
    plans: DataFrame, evidence: DataFrame, missing: DataFrame, memory: DataFrame | None = None,
    coverage_template: str = "{expected} = {covered} + {missing}", none_text: str = "-",
) -> DataFrame:
    """Prompt parts per question: numbered redacted blocks, coverage line, memory.

    The coverage line of a question that expects coverage is ``coverage_template`` with its keys; null for others.
    A question has at most ``context_limit`` (16) blocks, so the list per question
    is bounded.
    """
    section = F.when(
        F.coalesce("section", F.lit("")) != "", F.concat(F.lit("（"), "section", F.lit("）"))
    ).otherwise("")
    block = F.concat(
        F.lit("["), F.col("rank").cast("string"), F.lit("] "), "title", section,
        F.lit("\n"), redact_sensitive(F.coalesce("content", F.lit(""))),
    )
    blocks = (
        evidence.join(plans.select("question_id", "context_limit"), "question_id")
        .where(F.col("rank") <= F.col("context_limit"))
        .select("question_id", F.struct("rank", block.alias("text")).alias("block"))
        .groupBy("question_id")
        .agg(F.array_sort(F.collect_list("block")).alias("blocks"))
    )
    expected = F.coalesce("expected_coverage", F.array().cast("array<string>"))
    absent = F.coalesce("missing", F.array().cast("array<string>"))
    covered = F.filter(expected, lambda k: ~F.array_contains(absent, k))
    line = F.lit(coverage_template)
    for name, keys in (("expected", expected), ("covered", covered), ("missing", absent)):
        line = F.replace(line, F.lit(f"{{{name}}}"), F.when(F.size(keys) > 0, F.array_join(keys, "、")).otherwise(none_text))
    line = F.when(F.size(expected) > 0, line)
    joined = plans.join(blocks, "question_id", "left").join(missing, "question_id", "left")
    if memory is not None:
        joined = joined.join(memory.select("question_id", "summary"), "question_id", "left")
    else:
        joined = joined.withColumn("summary", F.lit(None).cast("string"))
    body = F.array_join(F.transform(F.coalesce("blocks", F.array().cast("array<struct<rank:int,text:string>>")), lambda b: b["text"]), "\n\n")
    return joined.select(
        "question_id",
        F.concat(F.lit("<knowledge_data>\n"), body, F.lit("\n</knowledge_data>")).alias("context"),
        line.alias("coverage_line"),
        F.when(
            F.coalesce("summary", F.lit("")) != "",
            F.concat(F.lit("<conversation_memory>\n"), "summary", F.lit("\n</conversation_memory>")),
        ).alias("memory"),
    )


def fallback_text(
    questions: DataFrame, evidence: DataFrame, template: str,
    none_text: str = fixed.NO_EVIDENCE_TEXT, preview: int = 80,
) -> DataFrame:
    """Text for questions without sufficient evidence, quoting the best chunk."""
    best = evidence.where(F.col("rank") == 1).select(
        "question_id", F.substring("content", 1, preview).alias("known")
    )
    return questions.select("question_id").join(best, "question_id", "left").select(
        "question_id",
        F.replace(
            F.lit(template), F.lit("{available_info}"), F.coalesce("known", F.lit(none_text))
        ).alias("fallback"),
    )


def suggest_followups(c_question, rules: Sequence[tuple[Sequence[str], Sequence[str]]], default: Sequence[str]):
    """Suggestions of the first rule one of whose keywords occurs in the question.

    The rules are configuration, so they become one CASE expression, not a join.
    """
    q = F.lower(c_question)
    texts = lambda values: F.array(*[F.lit(v) for v in values])
    chosen = None
    for words, suggestions in rules:
        hit = F.lit(False)
        for word in words:
            hit = hit | F.contains(q, F.lit(word))
        chosen = F.when(hit, texts(suggestions)) if chosen is None else chosen.when(hit, texts(suggestions))
    return texts(default) if chosen is None else chosen.otherwise(texts(default))
