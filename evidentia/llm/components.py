"""Connected components of a distributed list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from evidentia.llm.common import keep_small


def _none(df: DataFrame) -> bool:
    return not df.take(1)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` of every node of ``edges``; the component is its smallest node.

    Each round hooks every node to its smallest smaller neighbour, shortens the
    resulting trees by pointer jumping, and continues on the links between
    different trees. Minima are combined before the shuffle, so a node with very
    many links costs no more than any other; joins are plain equi-joins that
    adaptive execution may split. Every round is a written table.

    Self-links and repeated links are ignored; null ends and an empty table give no rows.
    """
    links = keep_small(_ordered(edges.select(F.col(a).alias("a"), F.col(b).alias("b"))), "links")
    label: DataFrame | None = None
    while not _none(links):
        parent = _jump(keep_small(links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent")), "hooks"))
        if label is None:
            roots = links.select(F.col("a").alias("node")).distinct().join(parent.select("node"), "node", "left_anti")
            label = parent.unionByName(roots.withColumn("parent", F.col("node")))
        else:
            label = _follow(label, parent)
        links = keep_small(_ordered(_follow(_follow(links, parent, "a"), parent, "b")), "links")
    if label is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return label.select("node", F.col("parent").alias("component"))


def _ordered(links: DataFrame) -> DataFrame:
    """Links from the smaller to the larger end, each once."""
    return (
        links.filter(F.col("a") != F.col("b"))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )


def _follow(rows: DataFrame, parent: DataFrame, column: str = "parent") -> DataFrame:
    """``column`` replaced by its root, where it has one."""
    up = parent.select(F.col("node").alias("_node"), F.col("parent").alias("_up"))
    others = [c for c in rows.columns if c != column]
    return rows.join(up, F.col(column) == F.col("_node"), "left").select(
        *others, F.coalesce("_up", column).alias(column)
    )


def _jump(parent: DataFrame) -> DataFrame:
    """Pointer jumping until every parent is a root."""
    while True:
        inner = parent.select(F.col("parent").alias("_of")).join(
            parent.select(F.col("node").alias("_of")), "_of", "left_semi"
        )
        if _none(inner):
            return parent
        parent = keep_small(_follow(parent, parent), "jump")
