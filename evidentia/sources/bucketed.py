"""Tables that are written in proportion to what changes: hash buckets, layers of changes, one manifest per version.

A table belongs to *owners* (one column): a change replaces all rows of an owner, or removes them. Rows lie in hash
buckets of their owner. A commit writes, for touched buckets only, the new rows and the list of changed owners; a
changed owner without rows is a tombstone. A bucket whose layers have outgrown a share of its base is written again as
a base, so reading stays cheap and a row is rewritten a bounded number of times. All tables of a store share their
versions: a commit covers several tables or none of them. A store has one writer at a time.
"""

from __future__ import annotations

import json
from collections.abc import Collection, Mapping
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from evidentia.session import broadcast_if_small
from evidentia.sources.tables import current_version

BUCKETS = 64
#: A bucket is written anew when its layers hold more than this share of its base.
FOLD = 0.5

_MANIFEST = "table string, owner string, buckets int, schema string, bucket int, kind string, version int, rows long, owners long"


class Entry(NamedTuple):
    """One line of a manifest: the table itself (``kind`` table), or a folder of one of its buckets (base or layer)."""

    table: str
    owner: str
    buckets: int
    schema: str
    bucket: int
    kind: str
    version: int
    rows: int
    owners: int

    def fields(self) -> StructType:
        return StructType.fromJson(json.loads(self.schema))


@dataclass
class Change:
    """New rows of owners, and owners that change without new rows (theirs are removed)."""

    rows: DataFrame | None = None
    owners: DataFrame | None = None


def create(spark: SparkSession, root: str, tables: Mapping[str, tuple[str, str]], buckets: int = BUCKETS) -> None:
    """A store of empty tables, ``{name: (owner column, schema)}``, as version 1."""
    if current_version(spark, root):
        raise ValueError("the store exists")
    _publish(spark, root, [
        Entry(name, owner, buckets, spark.createDataFrame([], schema).schema.json(), -1, "table", 1, 0, 0)
        for name, (owner, schema) in tables.items()
    ], 1)


def read(
    spark: SparkSession, root: str, table: str, version: int | None = None, buckets: Collection[int] | None = None
) -> DataFrame:
    """The table at ``version`` (by default the current one); with ``buckets``, only these are opened."""
    entries = manifest(spark, root, version)[table]
    return _merged(spark, root, [e for e in entries if buckets is None or e.kind == "table" or e.bucket in buckets])


def buckets_of(spark: SparkSession, root: str, table: str, owners: DataFrame) -> list[int]:
    """The buckets of these owners. A table has a fixed number of buckets, so they fit the driver."""
    facts = manifest(spark, root)[table][0]
    return [r.b for r in owners.select(_bucket(F.col(facts.owner), facts).alias("b")).distinct().collect()]


def commit(spark: SparkSession, root: str, changes: Mapping[str, Change], fold: float = FOLD) -> int:
    """Writes the changes of all tables and publishes them as one version, whose number is returned.

    The version log gets its row last. What a commit that died before has left is in no manifest, and
    the next one writes over it.
    """
    version = current_version(spark, root) + 1
    lines: list[Entry] = []
    for name, known in manifest(spark, root).items():
        if name in changes and len(known) == 1:
            known = known + _base(spark, root, known[0], changes[name].rows, version)
        elif name in changes:
            known = known + _layer(spark, root, known[0], changes[name], version)
            known = _folded(spark, root, known, version, fold)
        lines.extend(known)
    _publish(spark, root, lines, version)
    return version


def manifest(spark: SparkSession, root: str, version: int | None = None) -> dict[str, list[Entry]]:
    """The lines of every table, that of the table itself first."""
    number = current_version(spark, root) if version is None else version
    found: dict[str, list[Entry]] = {}
    lines = [Entry(*row) for row in spark.read.schema(_MANIFEST).json(f"{root}/_manifest/v{number}").collect()]
    for line in sorted(lines, key=lambda e: (e.table, e.kind != "table", e.bucket, e.version)):
        found.setdefault(line.table, []).append(line)
    return found


def _publish(spark: SparkSession, root: str, lines: list[Entry], version: int) -> None:
    spark.createDataFrame(lines, _MANIFEST).coalesce(1).write.mode("overwrite").json(f"{root}/_manifest/v{version}")
    spark.range(1).select(F.lit(version).alias("version")).coalesce(1).write.mode("append").json(f"{root}/_versions")


def _bucket(owner: Column, facts: Entry) -> Column:
    return F.pmod(F.xxhash64(owner), F.lit(facts.buckets)).cast("int")


def _write(rows: DataFrame, path: str) -> None:
    """One task writes a bucket, so there are no more files than touched buckets."""
    rows.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(path)


def _open(spark: SparkSession, folder: str, schema: StructType, entries: list[Entry]) -> DataFrame:
    """The rows of exactly these buckets, with ``_version`` and ``_bucket`` from their paths."""
    paths = [f"{folder}/_version={e.version}/_bucket={e.bucket}" for e in entries]
    whole = StructType([*schema.fields, StructField("_version", IntegerType()), StructField("_bucket", IntegerType())])
    return spark.read.schema(whole).option("basePath", folder).parquet(*paths) if paths else spark.createDataFrame([], whole)


def _layer(spark: SparkSession, root: str, facts: Entry, change: Change, version: int) -> list[Entry]:
    schema, folder = facts.fields(), f"{root}/{facts.table}"
    bucket = _bucket(F.col(facts.owner), facts)
    rows = spark.createDataFrame([], schema) if change.rows is None else change.rows.select(*schema.fieldNames())
    path = f"{folder}/rows/_version={version}"
    _write(rows.withColumn("_bucket", bucket), path)
    counts = _counts(spark, path)
    written = _open(spark, f"{folder}/rows", schema, [facts._replace(bucket=b, version=version) for b in counts])
    owners = written.select(facts.owner)
    if change.owners is not None:
        owners = owners.unionByName(change.owners.select(F.col(facts.owner).cast(schema[facts.owner].dataType).alias(facts.owner)))
    path = f"{folder}/owners/_version={version}"
    _write(owners.distinct().withColumn("_bucket", bucket), path)
    return [
        facts._replace(kind="layer", bucket=b, version=version, rows=counts.get(b, 0), owners=n) for b, n in _counts(spark, path).items()
    ]


def _base(spark: SparkSession, root: str, facts: Entry, rows: DataFrame | None, version: int) -> list[Entry]:
    """Rows written as the base of their buckets."""
    if rows is None:
        return []
    path = f"{root}/{facts.table}/base/_version={version}"
    _write(rows.select(*facts.fields().fieldNames()).withColumn("_bucket", _bucket(F.col(facts.owner), facts)), path)
    return [facts._replace(kind="base", bucket=b, version=version, rows=n) for b, n in _counts(spark, path).items()]


def _counts(spark: SparkSession, path: str) -> dict[int, int]:
    """Rows of every bucket just written, from the files' own row counts."""
    found = spark.read.schema("_bucket int").parquet(path).groupBy("_bucket").agg(F.count(F.lit(1)).alias("n"))
    return {r["_bucket"]: r["n"] for r in found.collect()}


def _merged(spark: SparkSession, root: str, entries: list[Entry]) -> DataFrame:
    """Bases without their changed owners, and of these the rows of their last change. Only buckets with layers are joined."""
    facts, parts = entries[0], entries[1:]
    schema, folder = facts.fields(), f"{root}/{facts.table}"
    names = schema.fieldNames()
    dirty = {e.bucket for e in parts if e.kind == "layer"}
    bases = [e for e in parts if e.kind == "base" and e.rows]
    clean = _open(spark, f"{folder}/base", schema, [e for e in bases if e.bucket not in dirty]).select(*names)
    if not dirty:
        return clean
    layers = [e for e in parts if e.kind == "layer"]
    key = StructType([schema[facts.owner]])
    last = (
        _open(spark, f"{folder}/owners", key, layers).groupBy(F.col(facts.owner).alias("_owner")).agg(F.max("_version").alias("_last"))
    )
    last = broadcast_if_small(last) if sum(e.owners for e in layers) <= 1_000_000 else last
    same = F.col(facts.owner).eqNullSafe(F.col("_owner"))
    kept = _open(spark, f"{folder}/base", schema, [e for e in bases if e.bucket in dirty]).join(last, same, "left_anti").select(*names)
    changed = _open(spark, f"{folder}/rows", schema, [e for e in layers if e.rows])
    live = changed.join(last, same & (F.col("_version") == F.col("_last"))).select(*names)
    return clean.unionByName(kept).unionByName(live)


def _folded(spark: SparkSession, root: str, entries: list[Entry], version: int, fold: float) -> list[Entry]:
    """The lines after buckets with too many changes have got a new base."""
    facts, base, layered = entries[0], {}, {}
    for e in entries[1:]:
        if e.kind == "base":
            base[e.bucket] = e.rows
        else:
            layered[e.bucket] = layered.get(e.bucket, 0) + e.rows + e.owners
    due = {b for b, n in layered.items() if n > fold * base.get(b, 0)}
    if not due:
        return entries
    rows = _merged(spark, root, [facts, *(e for e in entries[1:] if e.bucket in due)])
    return [e for e in entries if e.bucket not in due] + _base(spark, root, facts, rows, version)
