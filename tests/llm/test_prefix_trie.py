import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from evidentia.llm.prefix_trie import centroid_sums, numbered_turns, prefix_trie, with_shared_heads

SCHEMA = "conv_id long, turn long, role string, text string, depth string"


def table(spark, rows, parts=4):
    return spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(parts)


def expected(rows):
    """Rebuilt conversations and their trie by dictionaries; turns that tie keep any order, so tests let only equal turns tie."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = int(np.fix(c / 20)) * 20
        rebuilt[c] = own.get(base, [])[:h] + turns[h:]
    members, ends = {}, {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    children, leaves, saved = {}, {}, {}
    for path in members:
        if path:
            children[path[:-1]] = children.get(path[:-1], 0) + 1
    for path, convs in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        for d in range(len(path) + 1):
            leaves[path[:d]] = leaves.get(path[:d], 0) + (path not in children)
            saved[path[:d]] = saved.get(path[:d], 0) + (len(convs) - 1) * words
    return sorted(
        (
            min(convs), len(path), min(members[path[:-1]]) if path else -1, len(convs), children.get(path, 0), leaves[path], saved[path],
            hashlib.sha256(",".join(map(str, sorted(ends.get(path, [])))).encode()).hexdigest(),
        )
        for path, convs in members.items()
    )


def found(spark, rows, task_rows):
    convs, turns = with_shared_heads(numbered_turns(table(spark, rows)))
    return sorted(tuple(-1 if v is None else v for v in r) for r in prefix_trie(turns, convs, task_rows).collect())


def made(seed, convs, depth, words):
    r = random.Random(seed)
    return [
        (c, t, r.choice(["user", "assistant", None]), r.choice([None, "", "a b", "hello there you", " x\ty "][:words]))
        for c in range(convs) for t in range(r.randint(1, depth))
    ]


@pytest.mark.parametrize("task_rows", [3, 1 << 16])
def test_trie_of_random_conversations(spark, task_rows):
    rows = made(1, 90, 6, 3) + made(2, 30, 3, 5)[:0]
    rows += [(None, 0, "user", "lost"), (-7, 1, "user", "a b"), (-7, None, "user", "first"), (-20, 0, "user", "base"), (500, 0, "user", "solo")]
    assert found(spark, rows, task_rows) == expected(rows)


def test_a_long_conversation_is_split(spark):
    """Half of all rows are one chain; it is cut by centroids in several rounds, and by slices."""
    rows = [(1_000_003, t, "user", f"turn {t % 7} {t}") for t in range(900)] + made(5, 40, 5, 3)
    rows += [(1_000_023, t, "user", f"turn {t % 7} {t}") for t in range(700)]
    assert found(spark, rows, 64) == expected(rows)


def test_many_equal_conversations(spark):
    rows = [(c, t, "user", f"same {t}") for c in range(300) for t in range(3)] + [(7, 1, "user", "same 1")]
    assert found(spark, rows, 50) == expected(rows)


def test_conversations_without_turns_and_empty_tables(spark):
    assert found(spark, [], 8) == []
    lone = next(c for c in range(21, 400) if zlib.crc32(str(c).encode()) % 4 == 3 and c % 20)
    rows = [(lone, 0, "user", "gone"), (lone, 1, None, None)]
    assert found(spark, rows, 8) == expected(rows) and len(expected(rows)) == 1


def test_a_very_long_text_and_repeated_turns(spark):
    long = "word " * 400_000
    rows = [(c, t, "user", long if t == 1 else "q") for c in (20, 21, 22, 23, 24) for t in (0, 1, 1, 2)]
    assert found(spark, rows, 4) == expected(rows)


@pytest.mark.parametrize("shape", ["chain", "star", "random", "forest"])
def test_centroid_sums_are_subtree_sums(shape):
    r = np.random.default_rng(3)
    n = 400
    parent = {
        "chain": np.arange(n) - 1, "star": np.r_[-1, np.zeros(n - 1, dtype=int)],
        "random": np.r_[-1, [r.integers(0, k) for k in range(1, n)]],
        "forest": np.array([-1 if k < 5 else r.integers(0, k) for k in range(n)]),
    }[shape]
    own, values = r.integers(1, 9, n), r.integers(-50, 1 << 60, (n, 2)) // n
    depth, weight, sums = np.zeros(n, dtype=int), own.copy(), values.copy()
    for k in range(n):
        depth[k] = depth[parent[k]] + 1 if parent[k] >= 0 else 0
    for k in range(n - 1, -1, -1):
        if parent[k] >= 0:
            weight[parent[k]] += weight[k]
            sums[parent[k]] += sums[k]
    mixed = r.permutation(n)
    back = np.argsort(mixed)
    shuffled = np.where(parent[mixed] >= 0, back[parent[mixed]], -1)
    assert (centroid_sums(shuffled, depth[mixed], weight[mixed], values[mixed]) == sums[mixed]).all()
