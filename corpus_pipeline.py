"""From raw documents to packed training sequences: five stages, each written before the next one reads it.

Every stage takes ``(spark, docs, sf_dir)`` and, but for the last, returns documents with the columns it got.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from evidentia.llm import language_id, line_dedup, near_dup, packing, phrase_index
from evidentia.llm.common import fresh, keep, prepare

#: A text of so many letters and more that no language describes in longer phrases than this goes.
LEAST_LETTERS, LEAST_PHRASE = 200, 3.0


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: without a letter, or long and foreign to every language learned."""
    prepare(spark)
    lang, score, length = (fresh(docs, name) for name in language_id.ADDED)
    known = language_id.predict(docs, language_id.learn(docs), added=(lang, score, length))
    letters = F.length(F.regexp_replace("text", r"[^\p{L}]+", ""))
    foreign = (letters >= LEAST_LETTERS) & (F.col(length) < LEAST_PHRASE)
    return known.filter((F.col(lang) != "und") & ~foreign).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds are cut out; ``n_chars`` follows the text."""
    prepare(spark)
    cut = line_dedup.deduplicated(docs)
    if "n_chars" not in docs.columns:
        return cut
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8) stays."""
    prepare(spark)
    return _without(docs, near_dup.near_duplicates(docs).filter("not kept"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item go."""
    prepare(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = phrase_index.find_items(phrase_index.build_index(docs), benchmark)
    return _without(docs, found.filter("n_hit > 0"))


def _without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``docs`` but for the ids of ``rows``."""
    gone = fresh(docs, "_gone")
    return docs.join(rows.select(F.col("doc_id").alias(gone)).distinct(), F.col("doc_id").eqNullSafe(F.col(gone)), "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence of at most 2048 tokens and its place there."""
    prepare(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL cannot express language identification, sketches, or packing; the tests hold the rows against a brute-force version.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
