"""All pairs of vectors above a cosine, by an epsilon grid order join."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from evidentia.llm.common import keep, map_batches, prepare
from evidentia.llm.components import connected_components

#: Rows of a sequence interval that is compared as one block, and rows at which the recursion ends.
BLOCK_ROWS, LEAF_ROWS = 2048, 256
#: Leading principal dimensions that the grid order uses.
LEADING = 4


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(vec_id, vector)`` of the rows that can link: not null, finite, not zero."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.col("vector").isNotNull() & finite & F.exists("vector", lambda x: x != 0))


def principal_axes(vectors: DataFrame, count: int = LEADING) -> np.ndarray:
    """The ``count`` leading axes of unit vectors: moments are summed in the tasks, one matrix each reaches the driver."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = _unit(_matrix(batch.column("vector")))
                total = (0 if total is None else total) + x.T @ x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(total.size), type=pa.int32()), pa.array(total.ravel())], names=["place", "x"])

    parts = vectors.select("vector").mapInArrow(moments, "place int, x double").groupBy("place").agg(F.sum("x").alias("x"))
    cells = sorted((r["place"], r["x"]) for r in parts.collect())
    size = int(round(len(cells) ** 0.5))
    _, axes = np.linalg.eigh(np.array([x for _, x in cells]).reshape(size, size))
    return axes[:, ::-1][:, : min(count, size)]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # lengths neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _gap(low_a: np.ndarray, high_a: np.ndarray, low_b: np.ndarray, high_b: np.ndarray) -> float:
    """The squared distance of two boxes: no two rows of theirs are closer."""
    apart = np.maximum(0, np.maximum(low_a - high_b, low_b - high_a))
    return float((apart * apart).sum())


class _Pair:
    """The join of two sequence intervals: their links as counts per row and as a spanning forest."""

    def __init__(self, left: dict, right: dict | None, least: float, epsilon2: float, leaf_rows: int):
        self.least, self.epsilon2, self.leaf_rows = least, epsilon2, leaf_rows
        self.a = _rows(left)
        self.b = self.a if right is None else _rows(right)
        self.same = right is None
        self.links_a = np.zeros(len(self.a[0]), dtype=np.int64)
        self.links_b = self.links_a if self.same else np.zeros(len(self.b[0]), dtype=np.int64)
        self.parent: dict[int, int] = {}
        self.edges: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        while self.parent.get(x, x) != x:
            self.parent[x] = x = self.parent.get(self.parent[x], self.parent[x])
        return x

    def join(self, a: slice, b: slice) -> None:
        """Recursively halves the longer interval, and leaves out those whose boxes are too far apart."""
        keys_a, keys_b = self.a[2][a], self.b[2][b]
        if _gap(keys_a.min(0), keys_a.max(0), keys_b.min(0), keys_b.max(0)) > self.epsilon2:
            return
        n, m = a.stop - a.start, b.stop - b.start
        if max(n, m) <= self.leaf_rows:
            self.leaf(a, b)
        elif self.same and a == b:
            half = (a.start + a.stop) // 2
            low, high = slice(a.start, half), slice(half, a.stop)
            self.join(low, low)
            self.join(low, high)
            self.join(high, high)
        elif n >= m:
            half = (a.start + a.stop) // 2
            self.join(slice(a.start, half), b)
            self.join(slice(half, a.stop), b)
        else:
            half = (b.start + b.stop) // 2
            self.join(a, slice(b.start, half))
            self.join(a, slice(half, b.stop))

    def leaf(self, a: slice, b: slice) -> None:
        near = self.a[1][a] @ self.b[1][b].T >= self.least
        if self.same and a == b:
            near = np.triu(near, 1)
        rows, columns = np.nonzero(near)
        if not len(rows):
            return
        rows, columns = rows + a.start, columns + b.start
        np.add.at(self.links_a, rows, self.b[3][columns])
        np.add.at(self.links_b, columns, self.a[3][rows])
        for x, y in zip(self.a[0][rows].tolist(), self.b[0][columns].tolist()):
            p, q = self.root(x), self.root(y)
            if p != q:
                self.parent[max(p, q)] = min(p, q)
                self.edges.append((x, y))


def _rows(block: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    ids = np.frombuffer(block["ids"], dtype=np.int64)
    n = len(ids)
    return (
        ids, _unit(np.frombuffer(block["vectors"], dtype=f"f{block['width']}").reshape(n, -1).astype(np.float64)),
        np.frombuffer(block["keys"], dtype=np.float64).reshape(n, -1), np.frombuffer(block["copies"], dtype=np.int64),
    )


_BLOCK = "block string, width int, ids binary, vectors binary, keys binary, copies binary, low array<double>, high array<double>"


def _blocks(batches: Iterator[pa.RecordBatch], block_rows: int) -> Iterator[pa.RecordBatch]:
    """Runs of the sorted rows as blocks with the box of their keys."""
    for batch in batches:
        for start in range(0, batch.num_rows, block_rows):
            part = batch.slice(start, block_rows)
            keys, vectors = _matrix(part.column("key")), _matrix(part.column("vector"))
            narrow = vectors.astype(np.float32)
            if np.array_equal(narrow, vectors):  # given in single precision: sent as such, computed in double
                vectors = narrow
            arrays = [
                part.column("rep").to_numpy().astype(np.int64).tobytes(), vectors.tobytes(), keys.tobytes(),
                part.column("copies").to_numpy().astype(np.int64).tobytes(),
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array([uuid.uuid4().hex]), pa.array([vectors.itemsize], type=pa.int32()), *(pa.array([x], type=pa.binary()) for x in arrays), pa.array([keys.min(0).tolist()]), pa.array([keys.max(0).tolist()])],
                names=["block", "width", "ids", "vectors", "keys", "copies", "low", "high"],
            )


def vector_links(
    vectors: DataFrame, least: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = BLOCK_ROWS,
    leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row per input row.

    Rows link when their cosine, in double precision, is at least ``least``; null, zero and non-finite vectors
    and null ids link with nothing, vectors of different dimensions not with each other. ``n_links`` counts the
    other rows linked directly, ``component_id`` is the smallest id reachable.

    Each dimension is joined by itself. On unit vectors the condition is a distance of at most epsilon. Equal vectors are joined as one with a count. The
    others are sorted by their epsilon-wide grid cells on the leading principal dimensions and cut into
    intervals. Pairs of intervals whose boxes on these dimensions are within epsilon meet in a task,
    which splits them further and skips parts provably distant; it returns counts per row and a
    spanning forest of its links, never the links. Repeated ids are one node of the components; no rows for
    an empty table.
    """
    spark = prepare(vectors.sparkSession)
    usable = _usable(vectors, id_col, vector_col).filter("vec_id is not null")
    usable = usable.withColumn("_same", F.xxhash64("vector")).withColumn("_same2", F.hash("vector"))
    classes = usable.groupBy("_same", "_same2").agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector")
    )
    classes = keep(classes, "vectors")
    everything = vectors.select(F.col(id_col).alias("vec_id"), F.xxhash64(F.col(vector_col).cast("array<double>")).alias("_s"), F.hash(F.col(vector_col).cast("array<double>")).alias("_s2"))
    sizes = classes.groupBy(F.size("vector").alias("d")).count().filter("count > 1").orderBy("d").collect()  # one row a dimension
    parts = [_of_dimension(classes.filter(F.size("vector") == r["d"]), least, block_rows, leaf_rows).withColumn("d", F.lit(r["d"])) for r in sizes]
    found = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "a long, b long, n long, d int")
    direct = found.filter("b is null").groupBy(F.col("a").alias("_rep"), F.col("d").alias("_d")).agg(F.sum("n").alias("_links"))
    component = connected_components(found.filter("b is not null"))
    of_class = (
        classes.join(direct, (F.col("rep") == F.col("_rep")) & (F.size("vector") == F.col("_d")), "left").join(component, F.col("rep") == F.col("node"), "left")
        .select("_same", "_same2", (F.coalesce("_links", F.lit(0)) + F.col("copies") - 1).alias("_n"), F.coalesce("component", "rep").alias("_c"))
    )
    marked = everything.join(of_class, (F.col("_s") == F.col("_same")) & (F.col("_s2") == F.col("_same2")) & F.col("vec_id").isNotNull(), "left")
    return marked.select(
        "vec_id", F.coalesce("_n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("_c", "vec_id").alias("component_id"),
        F.coalesce(F.col("_c") == F.col("vec_id"), F.lit(True)).alias("kept"),
    )


def _of_dimension(classes: DataFrame, least: float, block_rows: int, leaf_rows: int) -> DataFrame:
    """The links among different vectors of one dimension, as ``_joined`` gives them."""
    axes, epsilon2 = principal_axes(classes), 2 - 2 * least + 1e-9

    def project(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keys = _unit(_matrix(batch.column("vector"))) @ axes
        cells = np.floor(keys / epsilon2**0.5).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [batch.column("rep"), batch.column("copies"), batch.column("vector"), pa.array(keys.tolist()), pa.array(cells.tolist(), type=pa.list_(pa.int32()))],
            names=["rep", "copies", "vector", "key", "cell"],
        )

    keyed = map_batches(classes, project, "rep long, copies long, vector array<double>, key array<double>, cell array<int>")
    order = [*(F.col("cell")[k] for k in range(axes.shape[1])), F.col("rep")]
    blocks = keep(keyed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(lambda rows: _blocks(rows, block_rows), _BLOCK), "intervals")
    return keep(_joined(blocks, least, epsilon2, leaf_rows), "joined")


def _joined(blocks: DataFrame, least: float, epsilon2: float, leaf_rows: int) -> DataFrame:
    """``(a, b, n)``: links of a spanning forest for each pair of blocks, and (b null) link counts per row."""
    epsilon = epsilon2**0.5
    boxes = blocks.select("block", "low", "high")
    first = lambda side, off: F.floor(F.col(side)[0] / epsilon + off)
    left = boxes.select(F.col("block").alias("i"), F.col("low").alias("low_i"), F.col("high").alias("high_i"), F.explode(F.sequence(first("low", 0), first("high", 0))).alias("cell"))
    right = boxes.select(F.col("block").alias("j"), F.col("low").alias("low_j"), F.col("high").alias("high_j"), F.explode(F.sequence(first("low", 0) - 1, first("high", 0) + 1)).alias("cell"))
    apart = F.zip_with(
        F.zip_with("low_i", "high_j", lambda x, y: x - y), F.zip_with("low_j", "high_i", lambda x, y: x - y),
        lambda x, y: F.pow(F.greatest(F.lit(0.0), x, y), 2),
    )
    near = left.join(right, "cell").filter("i <= j").filter(F.aggregate(apart, F.lit(0.0), lambda s, x: s + x) <= epsilon2)
    pairs = keep(near.select("i", "j").distinct(), "block-pairs")
    data = ["width", "ids", "vectors", "keys", "copies"]
    one = blocks.select(F.col("block").alias("i"), F.struct(*data).alias("left"))
    two = blocks.select(F.col("block").alias("j"), F.struct(*data).alias("right"))
    return map_batches(pairs.join(one, "i").join(two, "j").select("i", "j", "left", "right"), _meet(least, epsilon2, leaf_rows), "a long, b long, n long")


def _meet(least: float, epsilon2: float, leaf_rows: int):
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i, j, left, right in zip(*(batch.column(c) for c in ("i", "j", "left", "right"))):
            same = i.as_py() == j.as_py()
            pair = _Pair(left.as_py(), None if same else right.as_py(), least, epsilon2, leaf_rows)
            pair.join(slice(0, len(pair.a[0])), slice(0, len(pair.b[0])))
            sides = [(pair.a[0], pair.links_a)] + ([] if same else [(pair.b[0], pair.links_b)])
            ids = np.concatenate([x[n > 0] for x, n in sides])
            counts = np.concatenate([n[n > 0] for _, n in sides])
            a = np.concatenate((ids, np.array([e[0] for e in pair.edges], dtype=np.int64)))
            b = pa.array([None] * len(ids) + [e[1] for e in pair.edges], type=pa.int64())
            n = np.concatenate((counts, np.ones(len(pair.edges), dtype=np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(a), b, pa.array(n)], names=["a", "b", "n"])

    return run
