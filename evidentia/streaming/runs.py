"""Starting streams: state store, folders, and draining what is available."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from evidentia.session import prepare, shared_dir


def with_state_store(spark: SparkSession) -> SparkSession:
    """Keyed state lives in RocksDB, on disk and in checkpoints, not on the heap."""
    prepare(spark).conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    return spark


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/streams/{name}-{uuid.uuid4().hex}"


def start(stream: DataFrame, path: str, checkpoint: str, output_mode: str = "append") -> StreamingQuery:
    """Appends the stream to Parquet files; processes what is there and stops."""
    with_state_store(stream.sparkSession)
    return (
        stream.writeStream.format("parquet").outputMode(output_mode)
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Runs the stream over all available input and returns what it wrote."""
    spark = stream.sparkSession
    folder = new_folder(spark, name)
    start(stream, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
