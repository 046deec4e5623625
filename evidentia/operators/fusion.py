"""Candidate fusion, scoring, ranking, and merging of targets into evidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from evidentia import fixed_values as fixed
from evidentia.functions.text import cjk_bigrams, contains_any, normalize_key
from evidentia.operators.substring_join import substring_join


def fuse(vector: DataFrame, lexical: DataFrame) -> DataFrame:
    """Full union of both candidate lists; a missing side scores 0 and has no rank."""
    keys = ["target_id", "pass_no", "chunk_id"]
    left = vector.select(
        *keys, vector_score(F.col("similarity")).alias("vector_score"),
        F.col("rank").alias("vector_rank"),
    )
    right = lexical.select(*keys, "lexical_score", F.col("rank").alias("lexical_rank"))
    return left.join(right, keys, "full").na.fill(0.0, ["vector_score", "lexical_score"])


def vector_score(c_similarity: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c_similarity))


def base_score(c_vector: Column, c_lexical: Column, share: float = fixed.LEXICAL_SHARE) -> Column:
    return F.greatest(c_vector, c_lexical * share)


def mentioned_names(targets: DataFrame, aliases: DataFrame, key: str = "target_id") -> DataFrame:
    """``key, mentioned``: normalised canonical names with an alias in the query.

    ``aliases`` has one row per (canonical, alias).
    """
    asked = targets.select(key, normalize_key(F.col("query")).alias("_query"))
    names = aliases.select(
        normalize_key(F.col("canonical")).alias("_canonical"),
        normalize_key(F.col("alias")).alias("_alias"),
    )
    return (
        substring_join(asked, "_query", names, "_alias")
        .groupBy(key)
        .agg(F.collect_set("_canonical").alias("mentioned"))
    )


def title_boost(
    c_title: Column, c_query: Column, c_mentioned: Column,
    bonus: float = fixed.TITLE_BONUS, min_overlap: int = 2, c_key: Column | None = None,
) -> Column:
    """A mentioned entity is named in the title, or title and query share CJK pairs.

    ``c_key``: the title's :func:`normalize_key`, where many rows share a title and it is known already.
    """
    title = F.lower(F.coalesce(c_title, F.lit("")))
    names = F.coalesce(c_mentioned, F.array().cast("array<string>"))
    # The title is normalised once for all names, not again for each of them.
    normal = F.array(normalize_key(title) if c_key is None else F.coalesce(c_key, F.lit("")))
    named = F.exists(normal, lambda key: F.exists(names, lambda name: F.contains(key, name)))
    shared = F.size(F.array_intersect(cjk_bigrams(c_query), cjk_bigrams(title)))
    return F.when(named | (shared >= min_overlap), F.lit(bonus)).otherwise(F.lit(0.0))


def tag_boost(c_tags: Column, c_query: Column, bonus: float = fixed.TAG_BONUS) -> Column:
    normal = normalize_key(c_query)
    keys = F.filter(
        F.transform(F.coalesce(c_tags, F.array().cast("array<string>")), normalize_key),
        lambda t: t != "",
    )
    return F.when(F.exists(keys, lambda t: F.contains(normal, t)), F.lit(bonus)).otherwise(F.lit(0.0))


def entity_boost(
    c_project_id: Column, c_query: Column,
    words: Sequence[str] = fixed.ENTITY_WORDS, bonus: float = fixed.ENTITY_BONUS,
) -> Column:
    hit = c_project_id.isNotNull() & contains_any(F.lower(c_query), words)
    return F.when(hit, F.lit(bonus)).otherwise(F.lit(0.0))


def boosted_score(c_base: Column, *boosts: Column) -> Column:
    total = c_base
    for boost in boosts:
        total = total + boost
    return F.least(F.lit(1.0), total)


def rrf_bonus(
    c_score: Column, c_vector_rank: Column, c_lexical_rank: Column,
    k: int = fixed.RRF_K, weight: float = fixed.RRF_WEIGHT,
) -> Column:
    """Small reward for chunks found by both searches."""
    closeness = (1.0 / (c_vector_rank + k) + 1.0 / (c_lexical_rank + k)) / (2.0 / (k + 1))
    both = c_vector_rank.isNotNull() & c_lexical_rank.isNotNull()
    return F.when(both, F.least(F.lit(1.0), c_score + closeness * weight)).otherwise(c_score)


def score_candidates(candidates: DataFrame) -> DataFrame:
    """Final unrounded ``score`` of candidates that carry query and chunk columns."""
    base = base_score(F.col("vector_score"), F.col("lexical_score"))
    boosted = boosted_score(
        base,
        title_boost(F.col("title"), F.col("query"), F.col("mentioned")),
        tag_boost(F.col("tags"), F.col("query")),
        entity_boost(F.col("project_id"), F.col("query")),
    )
    return candidates.withColumn("score", boosted).withColumn(
        "score", rrf_bonus(F.col("score"), F.col("vector_rank"), F.col("lexical_rank"))
    )


def apply_threshold(scored: DataFrame, min_score: float, digits: int = 4) -> DataFrame:
    """The threshold sees the unrounded score; what is reported and ranked is rounded."""
    return scored.where(F.col("score") >= min_score).withColumn("score", F.round("score", digits))


def candidate_order() -> list[Column]:
    return [
        F.desc("score"), F.asc_nulls_last("vector_rank"), F.asc_nulls_last("lexical_rank"), F.asc("chunk_id"),
    ]


def first_productive_pass(ranked: DataFrame) -> DataFrame:
    """Keep, per target, only the strictest pass that left any candidate."""
    first = F.min("pass_no").over(W.partitionBy("target_id"))
    return ranked.withColumn("_first", first).where(F.col("pass_no") == F.col("_first")).drop("_first")


def cap_per_document(ranked: DataFrame, n: int = 2) -> DataFrame:
    """At most ``n`` chunks of a document per target; chunks without a document are exempt."""
    per_document = W.partitionBy("target_id", "pass_no", "document_id").orderBy(*candidate_order())
    return (
        ranked.withColumn("_n", F.row_number().over(per_document))
        .where(F.col("document_id").isNull() | (F.col("_n") <= n))
        .drop("_n")
    )


def topk_per_target(ranked: DataFrame, k: str = "k") -> DataFrame:
    """Best ``k`` (a column) per target, numbered in ``position``."""
    order = W.partitionBy("target_id").orderBy(*candidate_order())
    return ranked.withColumn("position", F.row_number().over(order)).where(F.col("position") <= F.col(k))


def target_quota(targets: DataFrame, top_k: int) -> DataFrame:
    """``quota``, ``k`` and ``fetch_k`` per target; coverage plans take one chunk per target."""
    quota = F.when(F.col("requires_coverage"), F.lit(1)).otherwise(F.lit(top_k))
    k = F.greatest(F.lit(4), F.least(F.lit(top_k), F.col("quota") * 2))
    return targets.withColumn("quota", quota).withColumn("k", k).withColumn("fetch_k", F.col("k") * 2)


def merge_targets(results: DataFrame) -> DataFrame:
    """One row per (question, chunk): best score, sorted coverage keys, first position."""
    carried = [
        c for c in ("document_id", "title", "section", "content", "tags", "project_id", "project_slug")
        if c in results.columns
    ]
    return (
        results.where(F.col("position") <= F.col("quota"))
        .groupBy("question_id", "chunk_id")
        .agg(
            F.max("score").alias("score"),
            F.array_sort(F.collect_set("coverage_key")).alias("coverage_keys"),
            F.min(F.struct("target_no", "position")).alias("first_seen"),
            *[F.first(c).alias(c) for c in carried],
        )
    )


def final_limit(merged: DataFrame, plans: DataFrame, top_k: int) -> DataFrame:
    """Best rows per question; the limit depends on its plan. Adds ``rank``."""
    limit = F.when(F.col("requires_coverage"), F.col("context_limit")).otherwise(
        F.least(F.lit(top_k), F.col("context_limit"))
    )
    limits = plans.select("question_id", limit.alias("_limit"))
    order = W.partitionBy("question_id").orderBy(F.desc("score"), F.asc("first_seen"), F.asc("chunk_id"))
    return (
        merged.join(limits, "question_id")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= F.col("_limit"))
        .drop("_limit", "first_seen")
    )


def missing_coverage(evidence: DataFrame, plans: DataFrame) -> DataFrame:
    """``question_id, missing``: expected keys no kept chunk covers, in expected order."""
    covered = (
        evidence.select("question_id", F.explode("coverage_keys").alias("key"))
        .groupBy("question_id")
        .agg(F.collect_set("key").alias("covered"))
    )
    none = F.array().cast("array<string>")
    return plans.join(covered, "question_id", "left").select(
        "question_id",
        F.filter(
            F.coalesce("expected_coverage", none),
            lambda key: ~F.array_contains(F.coalesce(F.col("covered"), none), key),
        ).alias("missing"),
    )


def attach_slug(evidence: DataFrame, entities: DataFrame) -> DataFrame:
    slugs = entities.select(F.col("entity_id").alias("project_id"), F.col("slug").alias("project_slug"))
    return evidence.join(slugs, "project_id", "left")
