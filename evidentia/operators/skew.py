"""Joins and numbering that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def salted_join(
    big: DataFrame, small: DataFrame, keys: Sequence[str], spread: Sequence[str],
    how: str = "inner", salts: int = 8,
) -> DataFrame:
    """Equi-join where a hot key of ``big`` is spread over ``salts`` tasks.

    Rows of ``big`` take a salt from their ``spread`` columns; ``small`` (at most a
    few rows per key) is repeated once per salt.
    """
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def number_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], slice_of: Column, name: str
) -> DataFrame:
    """Row number inside each key, without sorting a whole key in one task.

    ``slice_of`` must not decrease along ``order``. Rows are numbered inside their
    (key, slice); counts of earlier slices, one row per slice, give the offset.
    """
    sliced = df.withColumn("_slice", slice_of)
    counts = sliced.groupBy(*keys, "_slice").agg(F.count("*").alias("_n"))
    before = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(
        *keys, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    inside = W.partitionBy(*keys, "_slice").orderBy(*order)
    return (
        sliced.withColumn("_at", F.row_number().over(inside))
        .join(offsets, [*keys, "_slice"])
        .withColumn(name, F.col("_at") + F.col("_before"))
        .drop("_at", "_before", "_slice")
    )


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the greatest ``order`` per key.

    An aggregate, so a key that holds most rows is reduced before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(newest.alias("_row")).select(*keys, "_row.*").select(*df.columns)
