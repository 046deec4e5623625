"""Pinned answers: load them from Markdown and match questions to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from evidentia.functions.safety import compact_question, normalize_question
from evidentia.functions.text import strip
from evidentia.operators.substring_join import substring_join
from evidentia.session import cut_lineage


def load_faq(files: DataFrame, pinned: DataFrame) -> DataFrame:
    """``faq_order, title, answer`` of the pinned level-two headings in ``files(source_id, text)``.

    A title that occurs again keeps its place and takes the later answer.
    """
    sections = files.select(
        "source_id", F.posexplode(F.split("text", r"(?m)^##(?U:\s)+", -1)).alias("n", "part")
    ).withColumn("part", strip(F.col("part"))).where(F.col("part") != "")
    cut = F.locate("\n", F.col("part"))
    entries = sections.select(
        F.struct("source_id", "n").alias("at"),
        normalize_question(
            F.when(cut > 0, F.substring("part", F.lit(1), cut - 1)).otherwise(F.col("part"))
        ).alias("title"),
        F.when(cut > 0, strip(F.substring("part", cut + 1, F.length("part")))).otherwise("").alias("answer"),
    ).where(F.col("answer") != "")
    wanted = pinned.select(normalize_question(F.col("title")).alias("title")).distinct()
    return (
        entries.join(wanted, "title", "left_semi")
        .groupBy("title")
        .agg(F.min("at").alias("faq_order"), F.max_by("answer", "at").alias("answer"))
    )


def match_faq(questions: DataFrame, faq: DataFrame, min_len: int = 10) -> DataFrame:
    """``question_id, faq_title, answer`` of the first fitting entry.

    An exactly equal question wins; otherwise the first entry in table order that
    is equal in compact form, or contains / is contained in the question when the
    shorter of both has at least ``min_len`` characters. Three equi-joins, no
    nested loop. Each different compact form is compared once; only titles meet the questions, and answers are
    fetched for the entries that were chosen.
    """
    asked = cut_lineage(questions.select(
        "question_id",
        normalize_question(F.col("question")).alias("q_normal"),
        compact_question(F.col("question")).alias("q_compact"),
    ))
    entries = cut_lineage(faq.select("faq_order", "title", compact_question(F.col("title")).alias("t_compact")))
    first = F.min(F.struct("faq_order", F.col("title").alias("faq_title"))).alias("first")
    forms = asked.select("q_compact").distinct()
    titles = cut_lineage(entries.groupBy("t_compact").agg(first))
    long_forms = cut_lineage(forms.where(F.length("q_compact") >= min_len))
    long_titles = titles.where(F.length("t_compact") >= min_len).select("t_compact")
    close = substring_join(long_forms, "q_compact", long_titles, "t_compact").unionByName(
        substring_join(long_titles, "t_compact", long_forms, "q_compact").select("q_compact", "t_compact")
    )
    equal = forms.select("q_compact", F.col("q_compact").alias("t_compact"))
    nearest = close.unionByName(equal).join(titles, "t_compact").groupBy("q_compact").agg(F.min("first").alias("first"))
    same = entries.groupBy("title").agg(first).select(F.col("title").alias("q_normal"), "first")
    found = asked.join(same, "q_normal").select("question_id", F.lit(0).alias("class"), "first").unionByName(
        asked.join(nearest, "q_compact").select("question_id", F.lit(1).alias("class"), "first")
    )
    return (
        found.groupBy("question_id")
        .agg(F.min(F.struct("class", "first")).alias("best"))
        .select("question_id", "best.first.faq_title")
        .join(faq.select(F.col("title").alias("faq_title"), "answer"), "faq_title")
        .select("question_id", "faq_title", "answer")
    )
