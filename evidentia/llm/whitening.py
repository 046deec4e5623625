"""Whitening of vectors by a spectral divide and conquer: polar decompositions split the covariance into components."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from evidentia.llm.common import keep, prepare

STEP, ORIGIN = 64.0, 1_000_000
#: Entries beyond this many steps count as this many, so that whole numbers stay exact.
MOST_STEPS = float(1 << 52)
_LONG_MAX = (1 << 63) - 1


def polar_factor(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix, by QR-based dynamically weighted Halley steps.

    A direction whose singular value is less than 1e-16 of the largest may stay undecided (below 1).
    """
    x = a / max(float(np.linalg.norm(a)), np.finfo(float).tiny)
    eye, low = np.eye(len(a)), 1e-16
    for _ in range(12):
        square = low * low
        d = np.cbrt(4 * (1 - square) / (square * square))
        root = np.sqrt(1 + d)
        weight = root + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - square) / (square * root))
        b = (weight - 1) ** 2 / 4
        c = weight + b - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(c) * x, eye]))
        x, before = (b / c) * x + (weight - b / c) / np.sqrt(c) * (q[: len(a)] @ q[len(a) :].T), x
        low = min(1.0, low * (weight + b * square) / (1 + c * square))
        if 1 - low < 1e-15 and np.linalg.norm(x - before) < 1e-8 * len(a):
            break
    return (x + x.T) / 2


def _halves(a: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of two invariant subspaces, that of the larger eigenvalues first; None if all are equal."""
    size = len(a)
    middle = float(np.trace(a)) / size
    spread = float(np.linalg.norm(a - middle * np.eye(size)))
    if spread <= 4 * size * np.finfo(float).eps * float(np.linalg.norm(a)):
        return None
    best, least = None, np.inf
    draw = np.random.default_rng(size)
    for shift in (float(np.median(np.diag(a))), middle, middle + 0.07 * spread / size, middle - 0.07 * spread / size):
        projector = (polar_factor(a - shift * np.eye(size)) + np.eye(size)) / 2
        rank = round(float(np.trace(projector)))
        if not 0 < rank < size:
            continue
        basis = projector @ draw.standard_normal((size, rank))
        for _ in range(2):
            basis, _ = np.linalg.qr(basis)
            basis = projector @ basis
        whole, _ = np.linalg.qr(basis, mode="complete")
        upper, lower = whole[:, :rank], whole[:, rank:]
        left = float(np.linalg.norm(lower.T @ a @ upper))
        if left < least:
            best, least = (upper, lower), left
        if left <= 16 * size * np.finfo(float).eps * float(np.linalg.norm(a)):
            break
    return best


def leading_components(a: np.ndarray, count: int) -> np.ndarray:
    """Unit eigenvectors of the ``count`` largest eigenvalues of a symmetric matrix, as columns, largest first.

    A spectral projector, made from the polar factor of the shifted matrix, splits the space into two
    invariant subspaces; the matrix is restricted to each, upper one first, until a part has one
    dimension or one eigenvalue. Lower parts beyond ``count`` components are never split.
    """
    found: list[np.ndarray] = []
    waiting = [(a, np.eye(len(a)))]
    while waiting and len(found) < count:
        part, basis = waiting.pop()
        split = _halves(part) if len(part) > 1 else None
        if split is None:
            found.extend(basis.T)
            continue
        for half in reversed(split):
            inner = half.T @ part @ half
            waiting.append(((inner + inner.T) / 2, basis @ half))
    columns = np.array(found[:count]).reshape(-1, len(a)).T
    order = np.argsort(-np.einsum("ij,ij->j", columns, a @ columns), kind="stable")
    return columns[:, order]


@dataclass
class Whitening:
    """What the vectors of one dimension are whitened by."""

    n: int
    sums: list[int]
    scale: np.ndarray  # one column for each component: the unit eigenvector over the root of its eigenvalue
    explained: np.ndarray
    identity_error: float = 0.0

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """``n * x - sums``, exact: as 64-bit numbers, or as Python's where those could overflow."""
        whole = [s // self.n for s in self.sums]
        rest = np.array([s - self.n * w for s, w in zip(self.sums, whole)], dtype=np.int64)
        apart = x - np.array(whole, dtype=np.int64)
        if apart.size and int(np.abs(apart).max()) >= (1 << 61) // self.n:
            return apart.astype(object) * self.n - rest.astype(object)
        return apart * self.n - rest

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.deviations(x) / self.n).astype(np.float64)


def _squares(deviations: np.ndarray) -> list[int]:
    """Exact sums of squares per row; what a long cannot hold is the largest long."""
    if deviations.dtype != object and (not deviations.size or float(np.abs(deviations).max()) ** 2 * deviations.shape[1] < 2.0**62):
        return (deviations * deviations).sum(axis=1).tolist()
    return [min(_LONG_MAX, sum(int(v) ** 2 for v in row)) for row in deviations]


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(vec_id, x)``: entries as whole steps, ``floor(64 * c) + 1000000``; rows with null or non-finite entries are left out."""
    entries = F.col(vector_col).cast("array<double>")
    infinite = F.lit(float("inf"))
    fine = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != infinite))
    steps = lambda c: F.floor(F.greatest(F.lit(-MOST_STEPS), F.least(F.lit(MOST_STEPS), c * STEP))).cast("long") + F.lit(ORIGIN)
    return vectors.filter(F.col(vector_col).isNotNull() & fine & (F.size(vector_col) > 0)).select(
        F.col(id_col).alias("vec_id"), F.transform(entries, steps).alias("x")
    )


def _by_size(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The rows of each dimension: their numbers in the batch, and their entries as a matrix."""
    column = batch.column("x")
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy()
    sizes = np.diff(offsets)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield rows, values[offsets[rows][:, None] + np.arange(size)]


def _totals(fit: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Of each dimension: the number of vectors and the exact sums of their entries."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[int, int] = {}
        sums: dict[int, list[int]] = {}
        for batch in batches:
            for rows, x in _by_size(batch):
                size = x.shape[1]
                high, low = (x >> 32).sum(axis=0).tolist(), (x & 0xFFFFFFFF).sum(axis=0).tolist()
                n[size] = n.get(size, 0) + len(rows)
                sums[size] = [s + (h << 32) + v for s, h, v in zip(sums.get(size, [0] * size), high, low)]
        if n:
            flat = [(size, k, n[size], str(s)) for size in n for k, s in enumerate(sums[size])]
            yield pa.RecordBatch.from_pylist([dict(zip(("size", "place", "n", "total"), row)) for row in flat])

    parts = fit.select("x").mapInArrow(add, "size long, place long, n long, total string")
    totals = parts.groupBy("size", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    found: dict[int, tuple[int, list[int]]] = {}
    for size, _, n, total in sorted(totals.collect()):
        found.setdefault(size, (n, []))[1].append(int(total))
    return found


def _moments(fit: DataFrame, values: Callable[[np.ndarray], np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Of each dimension: the sums of ``values(x)`` and of their products, added up task by task, then row by row of the matrix."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in _by_size(batch):
                y = values(x)
                block = np.vstack([y.sum(axis=0), y.T @ y])
                held[x.shape[1]] = held[x.shape[1]] + block if x.shape[1] in held else block
        for size, block in held.items():
            for place, row in enumerate(block):
                yield pa.RecordBatch.from_pylist([{"size": size, "place": place, "row": row.tobytes()}])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for size, place, row in zip(*(c.to_pylist() for c in batch.columns)):
                part = np.frombuffer(row)
                held[size, place] = held[size, place] + part if (size, place) in held else part
        for (size, place), row in held.items():
            yield pa.RecordBatch.from_pylist([{"size": size, "place": place, "row": row.tobytes()}])

    schema = "size long, place long, row binary"
    parts = fit.select("x").mapInArrow(multiply, schema).repartition("size", "place").mapInArrow(add, schema)
    rows: dict[int, list[np.ndarray]] = {}
    for size, _, row in sorted((s, p, bytes(r)) for s, p, r in parts.collect()):
        rows.setdefault(size, []).append(np.frombuffer(row))
    return {size: (block[0], np.array(block[1:])) for size, block in rows.items()}


def learn_whitening(fit: DataFrame, components: int = 16) -> dict[int, Whitening]:
    """A whitening for each dimension of ``fit`` (distinct rows ``x``).

    Sums are exact, the covariance (divisor n) is of exactly centred vectors. What meets on the driver is
    one matrix for each dimension. A component whose eigenvalue is no more than rounding (1e-13 of the
    trace) cannot be whitened and is left out, so equal vectors give no components.
    """
    models = {size: Whitening(n, sums, np.zeros((size, 0)), np.zeros(0)) for size, (n, sums) in _totals(fit).items()}
    for size, (_, products) in _moments(fit, lambda x: models[x.shape[1]].centred(x)).items():
        model = models[size]
        covariance = products / model.n
        covariance = (covariance + covariance.T) / 2
        trace = float(np.trace(covariance))
        if trace <= 0:
            continue
        vectors = leading_components(covariance, components)
        values = np.einsum("ij,ij->j", vectors, covariance @ vectors)
        vectors, values = vectors[:, values > 1e-13 * trace], values[values > 1e-13 * trace]
        model.scale, model.explained = vectors / np.sqrt(values), values / trace
    for size, (total, products) in _moments(fit, lambda x: models[x.shape[1]].centred(x) @ models[x.shape[1]].scale).items():
        model = models[size]
        mean = total / model.n
        error = products / model.n - np.outer(mean, mean) - np.eye(len(mean))
        model.identity_error = float(np.abs(error).max()) if error.size else 0.0
    return models


def whiten(vectors: DataFrame, components: int = 16, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)`` of every usable vector and component.

    The fit list is every distinct quantised vector once, so copies weigh nothing. Rows whose vector is null, empty
    or holds null or non-finite entries are left out; repeated rows and repeated or null ids come back as often as they
    stand. Vectors of different dimensions are fitted and whitened apart. Entries beyond 2**52 steps count as that
    many; a deviation that a long cannot hold is the largest long. An empty table gives no rows. Only the models,
    one matrix of dimension x ``components`` for each dimension, are broadcast.
    """
    spark = prepare(vectors.sparkSession)
    rows = quantised(vectors, id_col, vector_col)
    models = learn_whitening(keep(rows.select("x").distinct(), "fit-list"), components)
    shared = spark.sparkContext.broadcast(pickle.dumps(models))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, Whitening] = pickle.loads(shared.value)
        for batch in batches:
            for places, x in _by_size(batch):
                model = known[x.shape[1]]
                count = model.scale.shape[1]
                deviations = model.deviations(x)
                whitened = (deviations / model.n).astype(np.float64) @ model.scale
                n = len(places)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id").take(pa.array(np.repeat(places, count))),
                        pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), n)), pa.array(np.full(n * count, model.n)),
                        pa.array(np.repeat(np.array(_squares(deviations), dtype=np.int64), count)), pa.array(whitened.ravel()),
                        pa.array(np.tile(model.explained, n)), pa.array(np.full(n * count, model.identity_error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    id_type = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(
        project, f"vec_id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    )
