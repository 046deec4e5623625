"""Session settings this library relies on, and the shared folder for checkpoints."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession, functions as F

# Results depend on these, so they are set on any session handed to us.
_REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}
#: Python workers hold whole Arrow batches, and copies of them as objects: batches are cut by bytes, not by rows alone.
_ARROW_BYTES = 4 << 20


def prepare(spark: SparkSession) -> SparkSession:
    for key, value in _REQUIRED.items():
        spark.conf.set(key, value)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", _ARROW_BYTES)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    Only a session on one machine (``local`` master, as in tests) that lacks the
    setting gets a folder of its own; a cluster without it is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
    folder = tempfile.mkdtemp(prefix="evidentia-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from the files."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, max_rows: int = 20_000) -> DataFrame:
    """Broadcast ``df`` only when it is proven to hold at most ``max_rows`` rows.

    The proof reads at most ``max_rows + 1`` rows. A larger table comes back
    without a hint, so the join shuffles (AQE splits skewed keys).
    """
    return F.broadcast(df) if holds_at_most(df, max_rows) else df


def holds_at_most(df: DataFrame, max_rows: int, max_bytes: int | None = None) -> bool:
    """Whether ``df`` has at most so many rows (and bytes of text and numbers); reads no more than proves it."""
    if max_bytes is None:
        return df.select(F.lit(1).alias("one")).limit(max_rows + 1).count() <= max_rows
    size = F.lit(0).cast("long")
    for name in df.columns:
        size = size + F.coalesce(F.octet_length(F.col(name).cast("string")), F.lit(0)) + F.lit(8)
    found = df.select(size.alias("size")).limit(max_rows + 1).agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).first()
    return found["n"] <= max_rows and (found["bytes"] or 0) <= max_bytes


def spread(scan: DataFrame, key: str) -> DataFrame:
    """Spread a file scan that has no more splits than the cluster has cores.

    A large table already has many splits and is returned as it is, without a
    shuffle. ``scan`` must be a plain scan, so that counting its splits runs nothing.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() > cores else scan.repartition(cores, key)
