"""JSON and Parquet sources and sinks, and versioned snapshots."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from evidentia.operators.html import sanitize
from evidentia.operators.ingest import upsert
from evidentia.functions.safety import safe_url

GOLDEN_SCHEMA = "id string, category string, question string, expected_sources array<string>"


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """Golden questions from a JSON array."""
    return spark.read.schema(GOLDEN_SCHEMA).option("multiLine", True).json(path)


def write_evaluation(result: DataFrame, path: str) -> None:
    """Rows of :func:`evidentia.operators.evaluation.evaluation_result` as JSON lines."""
    result.select("body").write.mode("overwrite").text(path)


def load(spark: SparkSession, path: str, **jdbc: str) -> DataFrame:
    """A stored table: Parquet, or an external database if connection options are given."""
    if jdbc:
        return spark.read.format("jdbc").options(dbtable=path, **jdbc).load()
    return spark.read.parquet(path)


def load_catalogue(existing: DataFrame | None, incoming: DataFrame, clear: bool = False) -> DataFrame:
    """Catalogue after an upsert by slug; bodies are cleaned and unsafe links dropped."""
    links = F.filter(
        F.transform(
            F.coalesce("related_links", F.array().cast("array<struct<label:string,url:string>>")),
            lambda l: F.struct(l["label"].alias("label"), safe_url(l["url"]).alias("url")),
        ),
        lambda l: l["url"].isNotNull(),
    )
    cleaned = incoming.withColumn("content_html", sanitize(F.col("content_html"))).withColumn("related_links", links)
    return cleaned if clear or existing is None else upsert(existing, cleaned, "slug")


def save_snapshot(spark: SparkSession, root: str, tables: Mapping[str, DataFrame], version: int) -> None:
    """Writes a new version of all tables, then makes it current.

    No path that is being read is overwritten; the version log gets its row last, so
    a job that dies before has no effect. A snapshot has one writer: a folder of this
    version that was finished by another one is an error, one left by a job that died is replaced.
    """
    if version <= current_version(spark, root):
        raise ValueError(f"version {version} is already written")
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}/v{version}")
    spark.range(1).select(F.lit(version).alias("version")).coalesce(1).write.mode("append").json(f"{root}/_versions")


def current_version(spark: SparkSession, root: str) -> int:
    """0 before the first snapshot."""
    try:
        log = spark.read.schema("version int").json(f"{root}/_versions")
    except Exception as error:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(error):
            return 0
        raise
    return log.agg(F.coalesce(F.max("version"), F.lit(0)).alias("v")).first()["v"]


def load_snapshot(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame:
    number = current_version(spark, root) if version is None else version
    return spark.read.parquet(f"{root}/{name}/v{number}")


