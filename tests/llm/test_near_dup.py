import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest

from evidentia.llm.near_dup import _SIZE, near_duplicates, sketch


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def brute(docs, size, percent=80):
    sets = [(d, shingles(t, size)) for d, t in docs]
    where = {}
    for k, (_, s) in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(k)
    common = Counter(p for ks in where.values() for p in itertools.combinations(ks, 2))
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), n in common.items():
        (da, x), (db, y) = sets[a], sets[b]
        if da is not None and db is not None and 100 * n >= percent * (len(x) + len(y) - n):
            low, high = sorted((find(da), find(db)))
            parent[high] = low
    return sorted(((d, len(s), find(d) if d is not None else None) for d, s in sets), key=str)


def rows(found):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()), key=str)


def copies(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    docs = []
    for _ in range(25):
        base = [word() for _ in range(r.randint(3, 120))]
        for _ in range(r.randint(1, 6)):
            text = list(base)
            for _ in range(r.randint(0, 4)):
                text[r.randrange(len(text))] = word()
            docs.append(" ".join(text))
    r.shuffle(docs)
    return [(k * 3 % 1009, t) for k, t in enumerate(docs)]


@pytest.mark.parametrize("size", [4, 5])
def test_groups_match_brute_force(documents, size):
    docs = copies(size) + [(5000, None), (5001, ""), (5002, " \n"), (5003, "one"), (5004, "ONE"), (None, "one"), (5005, "one two")]
    assert rows(near_duplicates(documents(docs), size=size)) == brute(docs, size)


def test_a_chain_of_drifting_copies_is_one_group(documents):
    """Neighbours are similar, ends are not, and no single centre reaches all."""
    words = [f"w{k}" for k in range(400)]
    docs = [(k, " ".join(words[4 * k : 4 * k + 80])) for k in range(60)]
    found = near_duplicates(documents(docs), size=4)
    assert rows(found) == brute(docs, 4) and {r.component_id for r in found.collect()} == {0}


def test_a_large_group_of_copies(documents):
    base = [f"w{k}" for k in range(90)]
    docs = [(k, " ".join(base)) for k in range(300)]
    docs += [(1000 + k, " ".join(base[:40] + [f"x{k}"] + base[41:])) for k in range(200)]
    docs += [(3000 + k, f"quite another text with number {k} in the middle of it") for k in range(50)]
    found = near_duplicates(documents(docs), size=4)
    assert rows(found) == brute(docs, 4) and sum(r.kept for r in found.collect()) == 51


def test_many_copies_around_the_threshold(documents):
    """Copies of one text that are partly similar enough, in several components that share buckets."""
    r = random.Random(8)
    base = [f"w{k}" for k in range(70)]
    docs = []
    for k in range(260):
        text = list(base)
        for at in r.sample(range(70), r.randint(1, 5)):
            text[at] = f"x{r.randrange(10**6)}"
        docs.append((k, " ".join(text)))
    expected = brute(docs, 4)
    assert 5 < len({c for _, _, c in expected}) < 250
    assert rows(near_duplicates(documents(docs), size=4)) == expected


def test_given_documents(documents, given):
    assert rows(near_duplicates(documents(given), size=4)) == brute(given, 4)


def test_repeated_ids_are_one_node(documents):
    a, b = " ".join(f"a{k}" for k in range(50)), " ".join(f"b{k}" for k in range(50))
    docs = [(9, a), (9, b), (9, b), (4, b), (12, a), (13, "c d e f g h")]
    found = near_duplicates(documents(docs), size=4)
    assert {(r.doc_id, r.component_id) for r in found.collect()} == {(9, 4), (4, 4), (12, 4), (13, 13)}
    assert near_duplicates(documents([])).collect() == []


@pytest.mark.parametrize("n", [1, 2, 20, 300, 5000])
def test_sketches_fill_and_estimate(n):
    r = np.random.default_rng(n)
    both = np.unique(r.integers(0, 2**63, 2 * n, dtype=np.int64).astype(np.uint64) * np.uint64(2))
    a, b = both, both[: max(1, int(len(both) * 0.8))]
    x, y = sketch(a), sketch(np.sort(b))
    assert len(x) == _SIZE and (sketch(a) == x).all()
    assert abs((x == y).mean() - len(b) / len(a)) < 0.2
