"""Proportional stratified interleaving: shards of equal row counts that all have the corpus's source mixture."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from evidentia.llm.common import numbered


def interleave(
    docs: DataFrame, n_shards: int = 8, seed: int = 17, id_col: str = "doc_id", text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """``(doc_id, source, size, text_crc32, shard, slot)``, one row per input row.

    Rows of a source are put in a seeded random order (by md5 of seed and id); row ``r`` of
    ``n`` of its source stands at ``(r - 0.5) / n``. The corpus sorted by that fraction is cut into
    ``n_shards`` runs whose counts differ by one at most, so each holds every source in
    proportion, to within about a row. ``slot`` is the place within the shard, from 0.

    ``size`` is the UTF-8 length of the text plus one, ``text_crc32`` its unsigned checksum; a null text
    has no bytes. Null sources form a source of their own, null ids an ordinary id. Repeated rows are
    rows like others. An empty table gives no rows. Columns beside the three named ones are not read.

    Ranks are taken in buckets of about the root of the row count, each preceded by the count of
    the buckets before it: neither a large source nor the global order ever meets in one task.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
    ).withColumn("_key", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"))))
    total = docs.count()
    buckets = max(1, math.isqrt(total))
    prefix = F.conv(F.substring("_key", 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("_bucket", F.shiftright(prefix * buckets, 32))

    order = ["_key", "doc_id", "text_crc32", "size"]
    in_source = numbered(rows, ["source"], "_bucket", order, "_rank")
    sizes = rows.groupBy(F.col("source").alias("_of")).agg(F.count(F.lit(1)).alias("_rows"))
    placed = in_source.join(sizes, F.col("source").eqNullSafe(F.col("_of"))).withColumn(
        "_at", (F.col("_rank") - 0.5) / F.col("_rows")
    )
    placed = placed.withColumn("_bucket", F.floor(F.col("_at") * buckets))
    place = numbered(placed, [], "_bucket", ["_at", F.asc_nulls_first("source"), *order], "_place")
    shard = F.floor((F.col("_place") - 1) * n_shards / F.lit(max(1, total)))
    # The first place of shard k is the smallest p with p * n_shards >= k * total.
    first = F.ceil(F.col("shard") * F.lit(total) / n_shards)
    return place.withColumn("shard", shard.cast("int")).select(
        "doc_id", "source", "size", "text_crc32", "shard", (F.col("_place") - 1 - first).cast("long").alias("slot")
    )


def write_shards(docs: DataFrame, assigned: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """The rows of ``docs`` in one folder per shard, in slot order. Ids must be unique."""
    places = assigned.select(F.col("doc_id").alias("_id"), "shard", "slot")
    (
        docs.drop("shard", "slot").join(places, F.col(id_col) == F.col("_id")).drop("_id")
        .repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
        .write.partitionBy("shard").parquet(path)
    )
