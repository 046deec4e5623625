"""Markdown files as a table, one row per file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_markdown(spark: SparkSession, root: str, pattern: str = "*.md") -> DataFrame:
    """``source_id, text, read_error`` of every file below ``root`` that fits ``pattern``.

    ``source_id`` starts with the last folder name of ``root``. Files that are not
    valid UTF-8 have a null text.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", True)
        .load(root)
    )
    return _decode(files, root)


def stream_markdown(spark: SparkSession, root: str, files_per_trigger: int = 10_000) -> DataFrame:
    """The same table as a stream of new and changed files."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = (
        spark.readStream.format("binaryFile").schema(schema)
        .option("pathGlobFilter", "*.md").option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", files_per_trigger)
        .load(root)
    )
    return _decode(files, root)


def _decode(files: DataFrame, root: str) -> DataFrame:
    base = root.rstrip("/").rsplit("/", 1)[-1]
    text = F.col("content").cast("string")
    valid = F.is_valid_utf8(text)
    # After the root folder the path is relative; the root may be given without a scheme.
    marker = root.rstrip("/").split("://")[-1]
    relative = F.substring_index(F.col("path"), marker + "/", -1)
    return files.select(
        F.concat(F.lit(base + "/"), relative).alias("source_id"),
        F.when(valid, text).alias("text"),
        (~valid).alias("read_error"),
    )
