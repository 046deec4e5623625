"""Question routing: what a question asks for, and the retrieval targets that follow.

Entities: ``entity_id, slug, title, sort_order``. Aliases: ``slug, alias``.
Domains: ``label, alias, sort_order``. Facets and patterns are configuration.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from evidentia import fixed_values as fixed
from evidentia.functions.text import normalize_key
from evidentia.operators.listing import numbered_lines, text_digest, whole_text
from evidentia.operators.substring_join import substring_join
from evidentia.session import holds_at_most

LIST, MULTI_ENTITY, SINGLE_ENTITY = "project_list", "multi_project", "single_project"
MULTI_PART, GENERAL = "multi_part", "general"

# Entities up to which the packed catalogue, one row, is broadcast.
MAX_CATALOGUE = 50_000

_ENTITY = "array<struct<sort_order:int,entity_id:bigint,slug:string,title:string>>"


@dataclass(frozen=True)
class RoutingRules:
    """Patterns (Java regular expressions) and facets of one knowledge base."""

    entity_word: str = fixed.ENTITY_WORD_PATTERN
    list_request: str = fixed.LIST_PATTERN
    all_entities: str = fixed.ALL_ENTITIES_PATTERN
    detail_request: str = fixed.DETAIL_PATTERN
    facets: Sequence[tuple[str, str, Sequence[str], str]] = fixed.FACETS
    default_facets: int = fixed.DEFAULT_FACETS
    clause_breaks: str = fixed.CLAUSE_BREAKS
    clause_filler: str = fixed.CLAUSE_FILLER
    clause_edge: str = fixed.CLAUSE_EDGE
    domain_query: str = "{domain}"


def mentioned_entities(questions: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """``question_id, entities``: entities whose title, slug or alias occurs in the question."""
    named = entities.select("entity_id", "slug", "title", F.col("sort_order").cast("int").alias("sort_order"))
    phrases = (
        named.select("slug", F.explode(F.array("title", "slug")).alias("phrase"))
        .unionByName(aliases.join(named.select("slug"), "slug", "left_semi").select("slug", F.col("alias").alias("phrase")))
        .select("slug", normalize_key(F.col("phrase")).alias("phrase"))
        .distinct()
    )
    asked = questions.select("question_id", normalize_key(F.col("question")).alias("normal"))
    return (
        substring_join(asked, "normal", phrases, "phrase", key="question_id")
        .select("question_id", "slug")
        .distinct()
        .join(named, "slug")
        .groupBy("question_id")
        .agg(
            F.array_sort(
                F.collect_list(F.struct("sort_order", F.col("entity_id").cast("long").alias("entity_id"), "slug", "title"))
            ).alias("entities")
        )
    )


def question_signals(questions: DataFrame, rules: RoutingRules = RoutingRules()) -> DataFrame:
    q = F.lower("question")
    return questions.select(
        "*",
        F.rlike(q, F.lit(rules.entity_word)).alias("has_entity_word"),
        F.rlike(q, F.lit(rules.list_request)).alias("list_request"),
        F.rlike(q, F.lit(rules.all_entities)).alias("all_entities"),
        F.rlike(q, F.lit(rules.detail_request)).alias("detail_request"),
    )


def match_facets(c_question: Column, rules: RoutingRules = RoutingRules()) -> Column:
    """Facets the question asks for, in order; the defaults if it asks for none."""

    def facet(label, terms, sections, _pattern):
        return F.struct(
            F.lit(label).alias("label"),
            F.lit(terms).alias("terms"),
            F.array(*[F.lit(s) for s in sections]).alias("section_terms"),
        )

    asked = F.array_compact(
        F.array(*[F.when(F.rlike(c_question, F.lit(f"(?i){f[3]}")), facet(*f)) for f in rules.facets])
    )
    usual = F.array(*[facet(*f) for f in rules.facets[: rules.default_facets]])
    return F.when(F.size(asked) > 0, asked).otherwise(usual)


def match_domains(questions: DataFrame, domains: DataFrame) -> DataFrame:
    """``question_id, domains``: labels with an alias in the question, in table order."""
    asked = questions.select("question_id", F.lower("question").alias("lowered"))
    return (
        substring_join(asked, "lowered", domains, "alias", key="question_id")
        .select("question_id", "sort_order", "label")
        .distinct()
        .groupBy("question_id")
        .agg(F.array_sort(F.collect_list(F.struct("sort_order", "label"))).alias("found"))
        .select("question_id", F.transform("found", lambda d: d["label"]).alias("domains"))
    )


def split_clauses(c_question: Column, rules: RoutingRules = RoutingRules(), min_len: int = 3) -> Column:
    """Distinct clauses of a compound question; empty unless there are two or more."""
    edge = "[" + "".join("\\" + ch if ch in r"[]\^-&" else ch for ch in rules.clause_edge) + "]+"
    parts = F.transform(
        F.split(c_question, rules.clause_breaks, -1),
        lambda p: F.regexp_replace(F.regexp_replace(p, rf"\A{edge}|{edge}\z", ""), rules.clause_filler, ""),
    )
    kept = F.array_distinct(F.filter(parts, lambda p: F.length(p) >= min_len))
    return F.when(F.size(kept) >= 2, kept).otherwise(F.array().cast("array<string>"))


def requires_coverage(c_intent: Column) -> Column:
    return c_intent.isin(LIST, MULTI_ENTITY, MULTI_PART)


def context_limit(c_intent: Column, c_n: Column) -> Column:
    """Chunks a plan may use; ``c_n`` counts its targets (catalogue entries for a list)."""
    return (
        F.when(c_intent == LIST, F.greatest(F.lit(5), c_n))
        .when(c_intent == MULTI_ENTITY, F.least(F.lit(16), F.greatest(F.lit(6), c_n)))
        .when(c_intent == SINGLE_ENTITY, F.least(F.lit(8), F.greatest(F.lit(5), c_n * 2)))
        .when(c_intent == MULTI_PART, F.least(F.lit(10), F.greatest(F.lit(6), c_n * 2)))
        .otherwise(F.lit(5))
    )


def route_questions(
    questions: DataFrame,
    entities: DataFrame,
    aliases: DataFrame,
    domains: DataFrame,
    rules: RoutingRules = RoutingRules(),
) -> DataFrame:
    """One plan per question; the first rung of the ladder that fits decides."""
    catalogue = entities.agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    F.col("sort_order").cast("int").alias("sort_order"),
                    F.col("entity_id").cast("long").alias("entity_id"), "slug", "title",
                )
            )
        ).alias("catalogue")
    ).withColumn("wants_catalogue", F.lit(True))

    none = F.array().cast(_ENTITY)
    q = (
        question_signals(questions, rules)
        .join(mentioned_entities(questions, entities, aliases), "question_id", "left")
        .join(match_domains(questions, domains), "question_id", "left")
        .withColumn("mentions", F.coalesce("entities", none))
        .withColumn("domains", F.coalesce("domains", F.array().cast("array<string>")))
        .withColumn("clauses", split_clauses(F.col("question"), rules))
        .withColumn("facets", match_facets(F.col("question"), rules))
    )
    is_list = F.col("has_entity_word") & F.col("list_request") & ~F.col("detail_request")
    wants_all = F.col("has_entity_word") & F.col("all_entities")
    # Only questions that ask for the whole catalogue meet it (one row, entity dimension).
    q = q.withColumn("wants_catalogue", is_list | wants_all).join(
        F.broadcast(catalogue) if holds_at_most(entities, MAX_CATALOGUE) else catalogue, "wants_catalogue", "left"
    )
    selected = (
        F.when(wants_all & (F.size(F.coalesce("catalogue", none)) > 0), F.col("catalogue"))
        .when(F.size("mentions") >= 2, F.col("mentions"))
        .otherwise(none)
    )
    q = q.withColumn("selected", selected)
    intent = (
        F.when(is_list, LIST)
        .when(F.size("selected") > 0, MULTI_ENTITY)
        .when(F.size("mentions") == 1, SINGLE_ENTITY)
        .when((F.size("domains") >= 2) | (F.size("clauses") >= 2), MULTI_PART)
        .otherwise(GENERAL)
    )
    q = q.withColumn("intent", intent)
    of_entities = F.col("intent").isin(MULTI_ENTITY, SINGLE_ENTITY)
    q = q.withColumn(
        "entities",
        F.when(F.col("intent") == MULTI_ENTITY, F.col("selected"))
        .when(F.col("intent") == SINGLE_ENTITY, F.col("mentions"))
        .otherwise(none),
    ).withColumn(
        "parts",
        F.when(F.col("intent") != MULTI_PART, F.array().cast("array<string>"))
        .when(F.size("domains") >= 2, F.transform("domains", lambda d: d))
        .otherwise(F.col("clauses")),
    )
    n = (
        F.when(F.col("intent") == LIST, F.size(F.coalesce("catalogue", none)))
        .when(of_entities, F.size("entities") * F.size("facets"))
        .otherwise(F.size("parts"))
    )
    expected = (
        F.when(
            of_entities,
            F.flatten(
                F.transform(
                    "entities",
                    lambda e: F.transform("facets", lambda f: F.concat(e["title"], F.lit("/"), f["label"])),
                )
            ),
        )
        .otherwise(F.col("parts"))
    )
    return q.select(
        "question_id", "question", "intent", "entities", "facets",
        (F.size("domains") >= 2).alias("by_domain"), "parts",
        requires_coverage(F.col("intent")).alias("requires_coverage"),
        expected.alias("expected_coverage"),
        context_limit(F.col("intent"), n).cast("int").alias("context_limit"),
    )


def expand_targets(plans: DataFrame, rules: RoutingRules = RoutingRules()) -> DataFrame:
    """One row per retrieval target: entity and facet, domain, clause, or the question itself."""
    prefix, suffix = rules.domain_query.split("{domain}")
    target = "array<struct<query:string,coverage_key:string,project_id:bigint,project_slug:string,section_terms:array<string>>>"

    def of(query, key, entity=None, slug=None, sections=None):
        return F.struct(
            query.alias("query"), key.alias("coverage_key"),
            (F.lit(None).cast("long") if entity is None else entity).alias("project_id"),
            (F.lit(None).cast("string") if slug is None else slug).alias("project_slug"),
            (F.array().cast("array<string>") if sections is None else sections).alias("section_terms"),
        )

    by_facet = F.flatten(
        F.transform(
            "entities",
            lambda e: F.transform(
                "facets",
                lambda f: of(
                    F.concat(e["title"], F.lit("："), f["terms"]),
                    F.concat(e["title"], F.lit("/"), f["label"]),
                    e["entity_id"], e["slug"], f["section_terms"],
                ),
            ),
        )
    )
    by_part = F.transform(
        "parts",
        lambda p: of(
            F.when(F.col("by_domain"), F.concat(F.lit(prefix), p, F.lit(suffix))).otherwise(p), p
        ),
    )
    whole = F.array(of(F.col("question"), F.lit(GENERAL)))
    targets = (
        F.when(F.col("intent") == LIST, F.array().cast(target))
        .when(F.col("intent").isin(MULTI_ENTITY, SINGLE_ENTITY), by_facet.cast(target))
        .when(F.col("intent") == MULTI_PART, by_part.cast(target))
        .otherwise(whole.cast(target))
    )
    return plans.select("question_id", F.posexplode(targets).alias("target_no", "t")).select(
        "question_id",
        (F.col("target_no") + 1).alias("target_no"),
        F.concat_ws("/", "question_id", F.col("target_no") + 1).alias("target_id"),
        "t.*",
    )


def list_answer(
    plans: DataFrame, entities: DataFrame, empty_text: str = fixed.NO_ENTITIES_TEXT,
    shown: Callable[[Column], Column] | None = None, digest: str | None = None,
) -> DataFrame:
    """Numbered catalogue titles for list questions; needs no retrieval.

    ``shown`` turns the one text of all questions into the ``content`` they get, before they meet it. With ``digest``,
    the name of a hash function, it turns the text's hexadecimal digest, and no task holds the text.
    """
    shown = shown or (lambda c: c)
    pieces, n = numbered_lines(entities, ["sort_order", "entity_id", "title"], "title")
    if n:
        content = text_digest(pieces, digest) if digest else whole_text(pieces)
    else:
        text = hashlib.new(digest, empty_text.encode()).hexdigest() if digest else empty_text
        content = entities.sparkSession.range(1).select(F.lit(text).alias("text"))
    listing = content.select(
        F.lit(LIST).alias("intent"), F.lit(n).cast("int").alias("n"), F.explode(F.array(shown(F.col("text")))).alias("content")
    )
    small = digest is not None or n <= MAX_CATALOGUE
    return plans.select("question_id", "intent").join(F.broadcast(listing) if small else listing, "intent").select(
        "question_id",
        "content",
        F.lit(1.0).alias("score"),
        F.array(F.lit(LIST)).alias("coverage_keys"),
        "n",
    )


def public_entities(entities: DataFrame, limit: int | None = None) -> DataFrame:
    kept = entities.where(F.col("visibility") == "public").orderBy(F.asc("sort_order"), F.desc("created_at"), F.asc("slug"))
    return kept.limit(limit) if limit else kept


def entity_by_slug(entities: DataFrame, slug: str) -> DataFrame:
    return entities.where((F.col("visibility") == "public") & (F.col("slug") == slug))
