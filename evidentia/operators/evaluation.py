"""Offline retrieval evaluation against a golden set."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def hit_at_k(golden: DataFrame, evidence: DataFrame, k: int = 5) -> DataFrame:
    """Per case: sources retrieved in the first ``k`` ranks, those expected among them, hit flag.

    ``golden``: id, expected_sources. ``evidence``: id, rank, source_id.
    """
    found = (
        evidence.where(F.col("rank") <= k)
        .groupBy("id")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "source_id"))).alias("found"))
        .select("id", F.transform("found", lambda f: f["source_id"]).alias("retrieved_sources"))
    )
    none = F.array().cast("array<string>")
    return (
        golden.join(found, "id", "left")
        .withColumn("retrieved_sources", F.coalesce("retrieved_sources", none))
        .withColumn(
            "matched_sources",
            F.array_sort(F.array_distinct(F.array_intersect("expected_sources", F.array_compact("retrieved_sources")))),
        )
        .withColumn("hit", F.when(F.size("matched_sources") > 0, 1.0).otherwise(0.0))
    )


def evaluation_summary(cases: DataFrame) -> DataFrame:
    """Hit rate, mean and 95th percentile (nearest rank) of the latency, and sample size."""
    return cases.agg(
        F.count("*").alias("sample_size"),
        F.round(F.avg("hit"), 4).alias("hit_rate"),
        F.round(F.avg("latency_ms"), 1).alias("mean_latency_ms"),
        F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY latency_ms)").alias("p95_latency_ms"),
    )


def evaluation_result(cases: DataFrame, dataset: str, generated_at: str, schema_version: int = 2) -> DataFrame:
    """Lines of the evaluation artifact: one summary row, then one row per case, as JSON.

    Cases stay distributed rows; the artifact is a JSON-lines folder, not one value.
    """
    summary = evaluation_summary(cases).select(
        F.lit("summary").alias("kind"),
        F.to_json(
            F.struct(
                F.lit(schema_version).alias("schema_version"), F.lit(generated_at).alias("generated_at"),
                F.lit(dataset).alias("dataset"), "sample_size",
                F.struct(
                    F.col("hit_rate").alias("hit_rate_at_5"),
                    F.col("mean_latency_ms").alias("average_retrieval_latency_ms"),
                    F.col("p95_latency_ms").alias("p95_retrieval_latency_ms"),
                ).alias("metrics"),
            )
        ).alias("body"),
    )
    fields = [c for c in ("id", "category", "question", "expected_sources", "retrieved_sources", "matched_sources") if c in cases.columns]
    rows = cases.select(
        F.lit("case").alias("kind"),
        F.to_json(F.struct(*fields, F.round("hit", 4).alias("hit_at_5"), "latency_ms")).alias("body"),
    )
    return summary.unionByName(rows)
