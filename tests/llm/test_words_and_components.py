import random
import re

import numpy as np
import pyarrow as pa
import pytest

from evidentia.llm import words
from evidentia.llm.common import prepare
from evidentia.llm.components import connected_components

PATTERNS = [(words.WHITE_SPACE, r"[^\x20\x09-\x0D]+"), (words.PUNCTUATION, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")]


def cut(pattern, text):
    return re.findall(pattern, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.mark.parametrize("window", [5, 17, 1 << 20])
@pytest.mark.parametrize("table, pattern", PATTERNS)
def test_words_are_those_of_the_pattern(monkeypatch, window, table, pattern):
    monkeypatch.setattr(words, "_WINDOW", window)
    words._powers.clear()
    r = random.Random(window)
    seen = {}
    for _ in range(40):
        texts = [None if r.random() < 0.1 else "".join(r.choice("aAbZz é\n\t.,-09ß漢 \x1c ") for _ in range(r.randint(0, 60))) for _ in range(7)]
        hashes, bounds = words.word_hashes(*words.utf8(pa.array(texts, type=pa.string())), table)
        for k, text in enumerate(texts):
            expected = cut(pattern, text)
            assert len(expected) == bounds[k + 1] - bounds[k]
            for word, value in zip(expected, hashes[bounds[k] : bounds[k + 1]].tolist()):
                assert seen.setdefault(word, value) == value
    assert len(set(seen.values())) == len(seen)
    words._powers.clear()


def test_sliced_columns_and_empty_tables():
    texts = pa.array(["a b", None, "c", "b"], type=pa.string())
    whole, _ = words.word_hashes(*words.utf8(texts), words.WHITE_SPACE)
    part, bounds = words.word_hashes(*words.utf8(texts.slice(1)), words.WHITE_SPACE)
    assert part.tolist() == whole[2:].tolist() and bounds.tolist() == [0, 0, 1, 2]
    none, bounds = words.word_hashes(*words.utf8(texts.slice(0, 0)), words.WHITE_SPACE)
    assert len(none) == 0 and bounds.tolist() == [0]


def roots(links):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        low, high = sorted((find(a), find(b)))
        parent[high] = low
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("nodes, count", [(30, 20), (200, 180), (50, 300)])
def test_components_match_union_find(spark, nodes, count):
    prepare(spark)
    r = np.random.default_rng(nodes)
    links = [(int(a), int(b)) for a, b in r.integers(0, nodes, (count, 2)) if a != b]
    found = connected_components(spark.createDataFrame(links, "a long, b long"))
    assert {x.node: x.component for x in found.collect()} == roots(links)


def test_components_of_a_star_a_chain_and_nothing(spark):
    star = [(0, k) for k in range(1, 400)]
    chain = [(1000 + k, 1001 + k) for k in range(60)]
    found = connected_components(spark.createDataFrame([*star, *chain, (5, 5), (None, 3)], "a long, b long"))
    assert {x.node: x.component for x in found.collect()} == roots([*star, *chain])
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
