"""Vector, lexical and hybrid retrieval over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from driver_queries.registry import Registry
from driver_queries.tables import (
    CHUNKS_SQL, QUESTIONS_SQL, TERMS_SQL, chunks, general_plans, general_targets, questions,
)
from evidentia.operators import candidates as find, fusion
from evidentia.plans.retrieval import retrieve

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


VECTOR_SQL = """
vector AS (
  SELECT * FROM (
    SELECT q.question_id, c.chunk_id, sim,
           row_number() OVER (PARTITION BY q.question_id ORDER BY sim DESC, c.chunk_id) AS vrank
    FROM questions q, corpus c, LATERAL (SELECT list_cosine_similarity(q.embedding, c.embedding) AS sim)
    WHERE c.embedding IS NOT NULL)
  WHERE vrank <= {k}
)"""

LEXICAL_SQL = """
lexical AS (
  SELECT question_id, chunk_id, raw, least(1.0, raw / greatest(1.0, 4.5 * n_terms)) AS lex,
         lrank
  FROM (
    SELECT question_id, chunk_id, raw, n_terms,
           row_number() OVER (PARTITION BY question_id ORDER BY raw DESC, chunk_id) AS lrank
    FROM (
      SELECT t.question_id, c.chunk_id, any_value(n.n_terms) AS n_terms,
             sum(CASE WHEN c.title ILIKE '%' || t.term || '%' ESCAPE '\\' THEN 2.0 ELSE 0.0 END
               + CASE WHEN c.section ILIKE '%' || t.term || '%' ESCAPE '\\' THEN 1.5 ELSE 0.0 END
               + CASE WHEN c.content ILIKE '%' || t.term || '%' ESCAPE '\\' THEN 1.0 ELSE 0.0 END)::DOUBLE AS raw
      FROM terms t JOIN (SELECT question_id, count(*) AS n_terms FROM terms GROUP BY 1) n USING (question_id),
           corpus c
      GROUP BY 1, 2)
    WHERE raw > 0)
  WHERE lrank <= {k}
)"""


@query(
    f"WITH {CHUNKS_SQL},{QUESTIONS_SQL},{VECTOR_SQL.format(k=10)}"
    " SELECT question_id, chunk_id, vrank AS rank,"
    " round(greatest(0.0, least(1.0, sim)), 6) AS vector_score FROM vector"
)
def vector_topk(spark, sf_dir):
    targets = general_targets(questions(spark, sf_dir)).withColumn("fetch_k", F.lit(10))
    corpus = find.filter_chunks(chunks(spark, sf_dir))
    return find.vector_topk(targets, corpus, max_k=10).select(
        F.col("target_id").alias("question_id"),
        "chunk_id",
        "rank",
        F.round(fusion.vector_score(F.col("similarity")), 6).alias("vector_score"),
    )


@query(
    f"WITH {QUESTIONS_SQL},{TERMS_SQL}"
    " SELECT question_id, string_agg(term, ' ' ORDER BY length(term) DESC, term) AS terms"
    " FROM terms GROUP BY 1"
)
def lexical_terms(spark, sf_dir):
    asked = general_targets(questions(spark, sf_dir))
    return find.question_terms(asked).select("question_id", F.array_join("terms", " ").alias("terms"))


@query(
    f"WITH {CHUNKS_SQL},{QUESTIONS_SQL},{TERMS_SQL},{LEXICAL_SQL.format(k=20)}"
    " SELECT question_id, chunk_id, lrank AS rank, raw AS raw_score, round(lex, 6) AS lexical_score FROM lexical"
)
def lexical_topk(spark, sf_dir):
    targets = general_targets(questions(spark, sf_dir)).withColumn("fetch_k", F.lit(20))
    corpus = find.filter_chunks(chunks(spark, sf_dir))
    return find.lexical_topk(targets, corpus, max_k=20).select(
        F.col("target_id").alias("question_id"), "chunk_id", "rank", "raw_score",
        F.round("lexical_score", 6).alias("lexical_score"),
    )


HYBRID_SQL = f"""WITH {CHUNKS_SQL},{QUESTIONS_SQL},{TERMS_SQL},{VECTOR_SQL.format(k=20)},{LEXICAL_SQL.format(k=20)},
fused AS (
  SELECT question_id, chunk_id, greatest(0.0, least(1.0, coalesce(sim, 0))) AS v, coalesce(lex, 0.0) AS l,
         vrank, lrank
  FROM vector FULL JOIN lexical USING (question_id, chunk_id)
),
boosted AS (
  SELECT f.*, c.document_id,
         least(1.0, greatest(v, 0.85 * l)
           + CASE WHEN len(list_filter(c.tags, lambda t: regexp_replace(lower(t), '[^0-9a-z]+', '', 'g') <> ''
                AND contains(regexp_replace(lower(q.question), '[^0-9a-z]+', '', 'g'),
                             regexp_replace(lower(t), '[^0-9a-z]+', '', 'g')))) > 0 THEN 0.10 ELSE 0.0 END
           + CASE WHEN c.project_id IS NOT NULL AND contains(lower(q.question), 'project') THEN 0.05 ELSE 0.0 END) AS b
  FROM fused f JOIN corpus c USING (chunk_id) JOIN questions q USING (question_id)
),
scored AS (
  SELECT *, CASE WHEN vrank IS NOT NULL AND lrank IS NOT NULL
                 THEN least(1.0, b + 0.04 * ((1.0 / (60 + vrank) + 1.0 / (60 + lrank)) / (2.0 / 61))) ELSE b END AS s
  FROM boosted
),
ranked AS (SELECT question_id, chunk_id, document_id, round(s, 4) AS score, vrank, lrank FROM scored WHERE s >= {{min_score}}),
capped AS (
  SELECT *, row_number() OVER (PARTITION BY question_id, document_id
             ORDER BY score DESC, vrank NULLS LAST, lrank NULLS LAST, chunk_id) AS per_doc FROM ranked
),
evidence AS (
  SELECT question_id, chunk_id, score, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY question_id
             ORDER BY score DESC, vrank NULLS LAST, lrank NULLS LAST, chunk_id) AS rank FROM capped WHERE per_doc <= 2)
  WHERE rank <= 5
)"""


@query(HYBRID_SQL.format(min_score=0.4) + " SELECT question_id, chunk_id, score, rank FROM evidence")
def hybrid_retrieval(spark, sf_dir):
    evidence, _ = general_evidence(spark, sf_dir)
    return evidence.select("question_id", "chunk_id", "score", "rank")


def general_evidence(spark, sf_dir, min_score=0.4, top_k=10):
    asked = questions(spark, sf_dir)
    return retrieve(
        general_plans(asked), general_targets(asked), chunks(spark, sf_dir),
        top_k=top_k, min_score=min_score,
    )
