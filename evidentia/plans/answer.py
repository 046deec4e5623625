"""Decides, per question, which way it is answered and prepares the answer's inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from evidentia import fixed_values as fixed
from evidentia.functions.safety import classify_safety, is_greeting, is_sensitive
from evidentia.functions.text import strip
from evidentia.operators import evidence as ev, routing
from evidentia.operators.faq import match_faq


def route_answers(
    plans: DataFrame,
    evidence: DataFrame,
    missing: DataFrame,
    faq: DataFrame,
    entities: DataFrame | None = None,
    min_score: float = 0.40,
    greeting_text: str = "",
    memory: DataFrame | None = None,
    listing_title: str = "",
    listing_section: str = "",
    list_lead: str = "",
    fallback_template: str = "{available_info}",
    coverage_template: str = "{expected} = {covered} + {missing}",
) -> DataFrame:
    """``question_id, route, answer, context, coverage_line, memory, citations``.

    Routes, first that fits: empty, unsafe, greeting, faq, sensitive, insufficient, list,
    generate. The catalogue is the evidence of a list question, under ``listing_title`` and
    ``listing_section``, and goes through the same gates as any other; ``list_lead`` stands before the
    lines, ``{n}`` in it for their number. ``answer`` is null where a text has to be generated
    from ``context``; generation is outside this library. ``fallback_template`` is the text of insufficient evidence. ``citations`` are those of
    listed and generated answers. ``plans`` are routed questions with their text.
    """
    questions = plans.select("question_id", "question")
    pinned = match_faq(questions, faq)
    listed = _listing(plans, entities, listing_title, listing_section)
    if listed is not None:
        others = plans.where(F.col("intent") != routing.LIST).select("question_id")
        evidence = evidence.join(others, "question_id", "left_semi").unionByName(listed.drop("n"), allowMissingColumns=True)
    gates = ev.evidence_gates(questions, evidence, min_score).select("question_id", "sufficient")
    fallback = ev.fallback_text(questions, evidence, fallback_template)
    context = ev.build_context(plans, evidence, missing, memory, coverage_template)
    q = (
        plans.select("question_id", "question", "intent")
        .join(pinned, "question_id", "left")
        .join(gates, "question_id", "left")
        .join(fallback, "question_id", "left")
        .join(context, "question_id", "left")
    )
    if listed is not None:
        lead = F.replace(F.lit(list_lead), F.lit("{n}"), F.col("n").cast("string"))
        text = F.when((F.col("n") > 0) & (lead != ""), F.concat(lead, F.lit("\n\n"), "content")).otherwise(F.col("content"))
        q = q.join(listed.select("question_id", text.alias("listing")), "question_id", "left")
    else:
        q = q.withColumn("listing", F.lit(None).cast("string"))
    shown = evidence.join(plans.select("question_id", "context_limit"), "question_id").where(F.col("rank") <= F.col("context_limit"))
    q = q.join(ev.citations_per_question(ev.format_citations(shown)), "question_id", "left")
    text = strip(F.coalesce("question", F.lit("")))
    route = (
        F.when(text == "", "empty")
        .when(classify_safety(text) != "safe", "unsafe")
        .when(is_greeting(text), "greeting")
        .when(F.col("answer").isNotNull(), "faq")
        .when(is_sensitive(text), "sensitive")
        .when(~F.coalesce("sufficient", F.lit(False)), "insufficient")
        .when(F.col("intent") == routing.LIST, "list")
        .otherwise("generate")
    )
    answer = (
        F.when(F.col("route") == "greeting", greeting_text)
        .when(F.col("route") == "faq", F.col("answer"))
        .when(F.col("route") == "list", F.coalesce("listing", F.lit(fixed.NO_ENTITIES_TEXT)))
        .when(F.col("route") == "insufficient", F.col("fallback"))
    )
    generate = F.col("route") == "generate"
    return (
        q.withColumn("route", route)
        .withColumn("answer", answer)
        .select(
            "question_id", "route", "answer",
            *[F.when(generate, F.col(c)).alias(c) for c in ("context", "coverage_line", "memory")],
            F.when(generate | (F.col("route") == "list"), F.col("citations")).alias("citations"),
        )
    )


def _listing(plans: DataFrame, entities: DataFrame | None, title: str, section: str) -> DataFrame | None:
    """The catalogue as the one piece of evidence of each list question."""
    if entities is None:
        return None
    return routing.list_answer(plans, entities).select(
        "question_id", F.lit(1).alias("rank"), F.lit("catalogue").alias("chunk_id"), F.lit(title).alias("title"),
        F.lit(section).alias("section"), "content", F.array().cast("array<string>").alias("tags"), "score", "coverage_keys", "n",
    )
