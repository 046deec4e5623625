import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.llm import vector_links as vl


def brute(rows, least=0.9):
    def unit(v):
        if v is None or len(v) != 4 or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        x = np.array(v, dtype=np.float64)
        return x / np.linalg.norm(x)

    units = [unit(v) if k is not None else None for k, v in rows]
    parent = {k: k for k, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(rows)
    for i, a in enumerate(units):
        for j in range(i):
            if a is not None and units[j] is not None and a @ units[j] >= least:
                links[i] += 1
                links[j] += 1
                low, high = sorted((find(rows[i][0]), find(rows[j][0])))
                parent[high] = low
    return sorted(((k, n, find(k) if k is not None else None) for (k, _), n in zip(rows, links)), key=str)


def rows_of(found):
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in found.collect()), key=str)


def make(spark, rows):
    return spark.createDataFrame([(k, v, 1, "x") for k, v in rows], "vec_id long, embedding array<float>, label int, rep string").repartition(3)


def cloud(seed, n):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((8, 4))
    x = (centres[r.integers(0, 8, n)] + 0.3 * r.standard_normal((n, 4))).astype(np.float32)
    return [(int(k), [float(y) for y in v]) for k, v in zip(r.permutation(n * 2)[:n], x)]


@pytest.mark.parametrize("block, leaf", [(2048, 256), (32, 8)])
def test_links_match_brute_force(spark, block, leaf):
    odd = [(9000, None), (9001, [0.0] * 4), (9002, [1.0, float("nan"), 0.0, 0.0]), (9003, [1.0, None, 0.0, 0.0]), (9004, [float("inf"), 0.0, 0.0, 0.0]),
           (9005, [1.0, 2.0]), (9006, []), (None, [1.0, 0.0, 0.0, 0.0])]
    rows = cloud(block, 300) + odd
    assert rows_of(vl.vector_links(make(spark, rows), block_rows=block, leaf_rows=leaf)) == brute(rows)


def test_many_copies_of_one_vector(spark):
    rows = cloud(3, 60) + [(1000 + k, [1.0, 0.5, 0.25, 0.0]) for k in range(200)]
    assert rows_of(vl.vector_links(make(spark, rows))) == brute(rows)


def test_kept_is_the_smallest_id(spark):
    found = vl.vector_links(make(spark, [(5, [1.0, 0.0, 0.0, 0.0]), (3, [1.0, 0.1, 0.0, 0.0]), (4, [0.0, 1.0, 0.0, 0.0])])).collect()
    assert {r.vec_id: r.kept for r in found} == {3: True, 4: True, 5: False}


def test_nothing_usable_and_no_rows(spark):
    assert rows_of(vl.vector_links(make(spark, [(1, None), (2, [0.0, 0.0])]))) == [(1, 0, 1), (2, 0, 2)]
    assert vl.vector_links(make(spark, [])).collect() == []


def test_distant_blocks_do_not_meet(spark, monkeypatch):
    met = []
    monkeypatch.setattr(vl, "keep", lambda df, name, keep=vl.keep: (met.append((name, keep(df, name))), met[-1][1])[1])
    r = np.random.default_rng(1)
    around = [(k, [math.cos(t), math.sin(t), 0.0, 0.0]) for k, t in enumerate(np.sort(r.uniform(0, 6.28, 512)).tolist())]
    found = vl.vector_links(spark.createDataFrame(around, "vec_id long, embedding array<double>"), block_rows=16)
    assert found.filter(F.col("n_links") > 0).count() > 0
    tables = dict(met)
    blocks = tables["intervals"].count()
    assert tables["block-pairs"].count() < 0.6 * blocks * (blocks + 1) / 2


def test_every_dimension_links_within_itself(spark):
    three = [(10_000 + k, v[:3]) for k, v in cloud(7, 80)]
    two = [(20_000 + k, v[:2]) for k, v in cloud(8, 20)] + [(30_000, [3.0]), (30_001, [5.0]), (30_002, [-1.0]), (40_000, [1.0] * 5), (40_001, [1.0] * 5)]
    four = cloud(9, 100)

    def plain(rows):
        """``brute`` knows four dimensions only."""
        units = {k: np.array(v, dtype=np.float64) / np.linalg.norm(v) for k, v in rows}
        links = {k: [j for j in units if j != k and len(units[j]) == len(units[k]) and units[j] @ units[k] >= 0.9] for k in units}
        smallest = dict.fromkeys(units)
        for k in sorted(units):
            todo = [k] if smallest[k] is None else []
            while todo:
                at = todo.pop()
                if smallest[at] is None:
                    smallest[at] = k
                    todo += links[at]
        return sorted(((k, len(links[k]), smallest[k]) for k in units), key=str)

    rows = four + three + two
    assert rows_of(vl.vector_links(make(spark, rows), block_rows=32, leaf_rows=8)) == plain(rows)
    # An id with vectors of two dimensions is one node.
    found = rows_of(vl.vector_links(make(spark, [(1, [1.0, 0.0]), (2, [1.0, 0.01]), (2, [1.0, 0.0, 0.0]), (3, [1.0, 0.01, 0.0])])))
    assert found == [(1, 1, 1), (2, 1, 1), (2, 1, 1), (3, 1, 1)]
