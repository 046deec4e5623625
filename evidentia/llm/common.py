"""What the operators of this subpackage share: session settings, written intermediate tables, Arrow mapping."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from evidentia.session import prepare as prepare_session, shared_dir

# Arrow batches are bounded by rows and by bytes, so long texts cannot fill a Python worker.
_BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


def prepare(spark: SparkSession) -> SparkSession:
    prepare_session(spark)
    for key, value in _BATCHES.items():
        spark.conf.set(key, value)
    return spark


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for an intermediate table in the folder that the whole cluster shares."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and continue from the files.

    This cuts the lineage: lost executors cost at most the tasks since the last table.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keep_small(df: DataFrame, name: str, per_core: int = 1) -> DataFrame:
    """``keep`` for a table small beside the corpus: no more files than ``per_core`` for each core of the cluster."""
    return keep(df.coalesce(max(1, per_core * df.sparkSession.sparkContext.defaultParallelism)), name)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``fn`` on every Arrow batch by itself; nothing is held from one batch to the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch)

    return df.mapInArrow(run, schema)


def text_frame(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text, under names that cannot clash; a null text is empty."""
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, longer by underscores until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fold(scale: int, id_col: str = "doc_id") -> F.Column:
    """crc32 of the id as text, modulo ``scale``: the fold a document belongs to (null ids: fold of the empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % F.lit(scale)


def numbered(rows: DataFrame, group: list[str], bucket: str, order: list, name: str) -> DataFrame:
    """``name`` numbers the rows of each group from 1 in the order of (bucket, order).

    Rows are numbered within a bucket and then moved by the count of the group's earlier buckets, so a
    large group is never sorted by one task.
    """
    counts = rows.groupBy(*group, bucket).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *(F.col(c).alias(f"_{c}") for c in group), F.col(bucket).alias("_b"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
    )
    same = F.col(bucket) == F.col("_b")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    local = F.row_number().over(Window.partitionBy(*group, bucket).orderBy(*order))
    numbered = rows.withColumn(name, local).join(offsets, same)
    return numbered.withColumn(name, F.col(name) + F.col("_offset")).drop("_offset", "_b", *(f"_{c}" for c in group))
