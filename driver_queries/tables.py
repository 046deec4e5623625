"""The given tables, shaped as the inputs the operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from evidentia.session import prepare, spread

# Tables with long texts, and the column their rows may be spread by.
_TEXTS = {"documents": "doc_id", "pages": "page_id"}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table = prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    # The tables hold UTC times without a zone; the session zone is UTC.
    zoned = {
        f.name: F.col(f.name).cast("timestamp") for f in table.schema if f.dataType.typeName() == "timestamp_ntz"
    }
    if name in _TEXTS:
        table = spread(table, _TEXTS[name])
    return table.withColumns(zoned) if zoned else table


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents, their vectors and labels as chunks; five neighbours form a document."""
    documents = load(spark, sf_dir, "documents")
    vectors = load(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id")
    labels = load(spark, sf_dir, "labels")
    return (
        documents.join(vectors, "doc_id", "left")
        .join(labels, "doc_id", "left")
        .select(
            F.col("doc_id").alias("chunk_id"),
            F.floor(F.col("doc_id") / 5).alias("document_id"),
            F.col("label").alias("project_id"),
            F.substring_index("text", "\n", 1).alias("title"),
            F.col("source").alias("section"),
            F.col("text").alias("content"),
            F.array("lang", "source").alias("tags"),
            F.when(F.col("toxic") == 1, "private").otherwise("public").alias("visibility"),
            F.when(F.col("quality") == 1, "confirmed")
            .when(F.col("quality") == 0, "unverified")
            .otherwise("self_reported")
            .alias("confidence"),
            "embedding",
        )
    )


CHUNKS_SQL = """
chunks AS (
  SELECT d.doc_id AS chunk_id, CAST(floor(d.doc_id / 5.0) AS BIGINT) AS document_id, e.label AS project_id,
         split_part(d.text, chr(10), 1) AS title, d.source AS section, d.text AS content,
         [d.lang, d.source] AS tags,
         CASE WHEN l.toxic = 1 THEN 'private' ELSE 'public' END AS visibility,
         CASE l.quality WHEN 1 THEN 'confirmed' WHEN 0 THEN 'unverified' ELSE 'self_reported' END AS confidence,
         CAST(e.embedding AS DOUBLE[]) AS embedding
  FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id
),
corpus AS (
  SELECT * FROM chunks WHERE visibility = 'public' AND confidence IN ('confirmed', 'self_reported')
)"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """benchmark passages as questions, with the vector of the same id."""
    vectors = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")
    return (
        load(spark, sf_dir, "benchmark")
        .join(vectors, "item_id", "left")
        .select(F.col("item_id").alias("question_id"), F.col("text").alias("question"), "embedding")
    )


QUESTIONS_SQL = """
questions AS (
  SELECT b.item_id AS question_id, b.text AS question, CAST(e.embedding AS DOUBLE[]) AS embedding
  FROM benchmark b LEFT JOIN embeddings e ON e.vec_id = b.item_id
)"""

# The stop terms are CJK, the test tables are not, so the oracle needs Latin terms only.
TERMS_SQL = """
terms AS (
  SELECT question_id, term FROM (
    SELECT question_id, term,
           row_number() OVER (PARTITION BY question_id ORDER BY length(term) DESC, term) AS n
    FROM (SELECT DISTINCT question_id,
                 unnest(regexp_extract_all(lower(question), '[a-z][a-z0-9_-]+')) AS term
          FROM questions))
  WHERE n <= 12
)"""


def general_plans(asked: DataFrame) -> DataFrame:
    """Every question asks for itself, without coverage."""
    return asked.select(
        "question_id",
        F.lit(False).alias("requires_coverage"),
        F.array().cast("array<string>").alias("expected_coverage"),
        F.lit(5).alias("context_limit"),
    )


def general_targets(asked: DataFrame) -> DataFrame:
    return asked.select(
        "question_id",
        F.lit(1).alias("target_no"),
        F.col("question_id").alias("target_id"),
        F.col("question").alias("query"),
        "embedding",
        F.lit("general").alias("coverage_key"),
    )
