"""Hybrid retrieval for a whole table of questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from evidentia.operators import candidates as find, fusion
from evidentia.session import broadcast_if_small, cut_lineage

#: What ranking reads of a chunk; its content is fetched for the ranked rows only.
CHUNK_COLUMNS = ("chunk_id", "document_id", "project_id", "title", "section", "tags")


def retrieve_targets(
    targets: DataFrame,
    chunks: DataFrame,
    *,
    max_k: int,
    min_score: float = 0.40,
    aliases: DataFrame | None = None,
    entities: DataFrame | None = None,
) -> DataFrame:
    """Ranked chunks per target, up to the target's ``k``; ``position`` counts from 1.

    Filters that leave a target empty are relaxed (without the section filter, then
    without the entity filter). All passes are scored in the same corpus scan, and
    the strictest productive one is kept, so no scan is repeated for relaxation.
    """
    corpus = find.filter_chunks(chunks)
    # Both searches and the scoring read the targets; their vectors may come from a model.
    targets = cut_lineage(targets)
    relaxable = "project_id" in targets.columns or "section_terms" in targets.columns
    passes = find.PASSES if relaxable else (1,)
    vector = find.vector_topk(targets, corpus, max_k=2 * max_k, passes=passes)
    lexical = find.lexical_topk(targets, corpus, max_k=2 * max_k, passes=passes)
    # A few rows per target, yet the product of two corpus scans: written once, so
    # that chunk columns can be fetched by a broadcast instead of a corpus shuffle.
    found = cut_lineage(fusion.fuse(vector, lexical))
    detailed = corpus.select(*CHUNK_COLUMNS).join(
        broadcast_if_small(found, 200_000), "chunk_id"
    )
    asked = targets.drop("project_id", "section_terms", "embedding")
    if aliases is not None:
        asked = asked.join(fusion.mentioned_names(asked, aliases), "target_id", "left")
    else:
        asked = asked.withColumn("mentioned", F.lit(None).cast("array<string>"))
    scored = fusion.score_candidates(detailed.join(asked, "target_id"))
    kept = fusion.first_productive_pass(fusion.apply_threshold(scored, min_score))
    ranked = _with_content(cut_lineage(fusion.topk_per_target(fusion.cap_per_document(kept))), corpus)
    return ranked if entities is None else fusion.attach_slug(ranked, entities)


def _with_content(ranked: DataFrame, corpus: DataFrame) -> DataFrame:
    """Late fetch: the only read of contents after the searches, for the chunks that made it into some list.

    Their ids are broadcast while proven few; else both sides are narrow but for the contents of these very chunks.
    """
    ids = ranked.select("chunk_id").distinct()
    texts = corpus.select("chunk_id", "content").join(broadcast_if_small(ids, 1_000_000), "chunk_id", "left_semi")
    return ranked.join(texts, "chunk_id", "left")


def retrieve(
    plans: DataFrame,
    targets: DataFrame,
    chunks: DataFrame,
    *,
    top_k: int = 10,
    min_score: float = 0.40,
    aliases: DataFrame | None = None,
    entities: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``(evidence, missing)`` for planned questions.

    ``plans``: question_id, requires_coverage, expected_coverage, context_limit.
    ``targets``: question_id, target_no, target_id, query, embedding, coverage_key
    and, optionally, project_id and section_terms.
    """
    sized = fusion.target_quota(
        targets.join(plans.select("question_id", "requires_coverage"), "question_id"), top_k
    )
    results = retrieve_targets(
        sized, chunks, max_k=max(4, top_k), min_score=min_score, aliases=aliases, entities=entities
    )
    evidence = fusion.final_limit(fusion.merge_targets(results), plans, top_k)
    return evidence, fusion.missing_coverage(evidence, plans)
