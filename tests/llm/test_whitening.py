import math

import numpy as np
import pytest

from evidentia.llm.whitening import Whitening, _squares, leading_components, polar_factor, whiten

SCHEMA = "vec_id long, embedding array<float>, label int, whitened string"


def vectors(spark, rows, parts=3):
    return spark.createDataFrame([(k, v, 0, "x") for k, v in rows], SCHEMA).repartition(parts)


def expected(rows, components=16):
    """The same by whole numbers and a library eigensolver: {(size): (n, deviations, projections, explained)}."""
    x = [(k, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for k, v in rows]
    fit = np.array(sorted({tuple(v) for _, v in x}), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    centred = ((fit * n - sums) / n).astype(float)
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    values, basis = values[::-1], basis[:, ::-1]
    kept = int((values[:components] > 1e-13 * values.sum()).sum())
    out = {}
    for k, v in x:
        d = [n * a - s for a, s in zip(v, sums)]
        out.setdefault(k, []).append((sum(e * e for e in d), (np.array(d, dtype=float) / n) @ basis[:, :kept] / np.sqrt(values[:kept])))
    return n, out, values[:kept] / values.sum()


def check(found, rows, components=16):
    n, out, explained = expected(rows, components)
    got = {}
    for r in found.collect():
        assert r.n == n and r.identity_error <= 1e-4
        assert abs(r.explained / explained[r.component - 1] - 1) < 1e-9
        got.setdefault(r.vec_id, []).append((r.component, r.deviation, r.whitened))
    assert set(got) == set(out) and sum(map(len, got.values())) == len(rows) * len(explained)
    for k, values in out.items():
        for component in range(1, len(explained) + 1):
            mine = sorted(abs(w) for c, _, w in got[k] if c == component)
            assert np.allclose(mine, sorted(abs(p[component - 1]) for _, p in values), atol=1e-9)
        assert {d for _, d, _ in got[k]} == {d for d, _ in values}


def test_rows_equal_those_of_an_eigensolver(spark):
    draw = np.random.default_rng(5)
    base = draw.standard_normal((300, 20)) * np.linspace(3, 0.2, 20)
    rows = [(k, v.tolist()) for k, v in enumerate(base)] + [(k, base[7].tolist()) for k in range(900, 1000)] + [(3, base[3].tolist())]
    found = whiten(vectors(spark, rows))
    check(found, rows)
    signs = {}  # one sign for all rows: components of the fit list are not correlated
    for r in found.filter("vec_id < 300").dropDuplicates(["vec_id", "component"]).collect():
        signs.setdefault(r.vec_id, {})[r.component] = r.whitened
    y = np.array([[v[c] for c in range(1, 17)] for v in signs.values()])
    assert np.abs(np.cov(y.T, bias=True) - np.eye(16)).max() < 1e-9


def test_given_vectors(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    check(whiten(table), [(r.vec_id, r.embedding) for r in table.collect()])


def test_unusable_rows_are_left_out(spark):
    good = [(k, [k * 0.5, (k * 7 % 5) * 1.0, 1.0]) for k in range(9)] + [(None, [0.25, 0.5, 0.75])]
    bad = [(50, None), (51, []), (52, [1.0, None, 2.0]), (53, [float("nan"), 1.0, 1.0]), (54, [1.0, float("inf"), 1.0])]
    found = whiten(vectors(spark, good + bad))
    check(found, good)


def test_equal_vectors_and_empty_tables_have_no_components(spark):
    assert whiten(vectors(spark, [])).collect() == []
    assert whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []


def test_dimensions_are_whitened_apart(spark):
    draw = np.random.default_rng(1)
    small = [(k, v.tolist()) for k, v in enumerate(draw.standard_normal((40, 2)))]
    large = [(100 + k, v.tolist()) for k, v in enumerate(draw.standard_normal((50, 5)))]
    found = whiten(vectors(spark, small + large))
    check(found.filter("vec_id < 100"), small)
    check(found.filter("vec_id >= 100"), large)


def test_huge_entries_have_a_defined_result(spark):
    rows = whiten(vectors(spark, [(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [0.0, 5.0])])).collect()
    assert {r.vec_id for r in rows} == {1, 2, 3} and all(math.isfinite(r.whitened) for r in rows)
    assert max(r.deviation for r in rows) == 2**63 - 1


def test_deviations_stay_exact():
    model = Whitening(3, [10, 2 * 10**17], np.zeros((2, 0)), np.zeros(0))
    x = np.array([[4, 10**17], [3, 5]], dtype=np.int64)
    whole = [[3 * 4 - 10, 3 * 10**17 - 2 * 10**17], [3 * 3 - 10, 15 - 2 * 10**17]]
    assert [[int(v) for v in row] for row in model.deviations(x)] == whole
    assert _squares(np.array([[3, 4]])) == [25]


@pytest.mark.parametrize("values", [[3.0, 2.0, 1.0], [5.0, 5.0, 5.0, 1.0, 1.0], [1.0] * 4, [7.0, 1e-9, 0.0, 0.0], list(np.geomspace(1e6, 1e-6, 40))])
def test_components_of_known_spectra(values):
    draw = np.random.default_rng(len(values))
    basis, _ = np.linalg.qr(draw.standard_normal((len(values), len(values))))
    a = basis @ np.diag(values) @ basis.T
    a = (a + a.T) / 2
    found = leading_components(a, len(values))
    assert np.abs(found.T @ found - np.eye(len(values))).max() < 1e-12
    assert np.allclose(np.diag(found.T @ a @ found), values, atol=1e-12 * max(values))
    assert np.linalg.norm(found.T @ a @ found - np.diag(values)) < 1e-11 * max(values)


def test_polar_factor_is_the_sign():
    a = np.diag([4.0, -1e-7, 2.0])
    assert np.allclose(polar_factor(a), np.diag([1.0, -1.0, 1.0]), atol=1e-12)
