import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given as drawn, settings, strategies as st
from tokenizers import Tokenizer

from evidentia.llm.byte_bpe import byte_bpe
from evidentia.llm.histogram_packing import combinations, pack_documents, plan, repeat_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def both():
    with open(PATH, encoding="utf-8") as file:
        spec = file.read()
    return byte_bpe(spec), Tokenizer.from_str(spec)


def ids(fast, text):
    return np.frombuffer(fast.ids(text.encode()), dtype="<u4").tolist()


def test_ids_are_the_tokenizers_own(both, given):
    fast, exact = both
    odd = ["<|endoftext|>", "a <|endoftext|> b", "it's we'll I'M", " lead", "tail ", "two  gaps\n\n x ", "a  b 　c", "", "x" * 5000, "y" + " " * 5000 + "z"]
    for text in odd + [t or "" for _, t in given]:
        assert ids(fast, text) == exact.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@drawn(st.text(alphabet="aAbzé'Éß ΣŁ \t\n\x0b\x1c\xa0　.,!?-_<|>0123漢😀ﬁ½²sthe", max_size=40))
def test_ids_of_any_text(both, text):
    fast, exact = both
    assert ids(fast, text) == exact.encode(text, add_special_tokens=False).ids


def check(rows, docs, exact, capacity):
    """Pieces tile every document, sequences are gapless; the share of padding."""
    texts = {}
    for doc, text in docs:
        texts.setdefault(doc, []).append(exact.encode(text or "", add_special_tokens=False).ids + [1])
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(pieces) == set(texts)
    for doc, wanted in texts.items():
        if len(wanted) == 1:
            own, at = wanted[0], 0
            for r in sorted(pieces[doc], key=lambda r: r.start):
                assert r.start == at and r.doc_tokens == len(own) and r.length > 0
                assert r.ids_crc32 == zlib.crc32(np.array(own[at : at + r.length], dtype="<u4").tobytes())
                at += r.length
            assert at == len(own)
        else:
            assert sum(r.length for r in pieces[doc]) == sum(map(len, wanted))
    total = padded = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
        total, padded = total + at, padded + (at if at & (at - 1) == 0 else capacity)
    return (padded - total) / max(1, padded)


def test_pieces_and_places(both, documents, given):
    docs = given + [(900, None), (901, ""), (None, "hello world"), (5, "again"), (5, "again"), (902, "word " * 9000)]
    found = pack_documents(documents(docs), PATH).collect()
    assert check(found, docs, both[1], 2048) < 0.02


def test_one_class_holds_most_and_is_cut(both, documents):
    """Two documents of 81 tokens never fit into 128 places: only cuts keep the padding small."""
    docs = [(k, "five " * 80) for k in range(300)] + [(1000 + k, "a b c") for k in range(30)]
    found = pack_documents(documents(docs, parts=8), PATH, capacity=128).collect()
    assert len(found) > 330 and check(found, docs, both[1], 128) < 0.1


def test_the_ids_themselves(both, documents):
    docs = [(k, "some words " * (1 + k % 37)) for k in range(80)]
    rows = pack_documents(documents(docs), PATH, capacity=64, with_ids=True).collect()
    check(rows, docs, both[1], 64)
    for doc, text in docs:
        own = b"".join(bytes(r.ids) for r in sorted((r for r in rows if r.doc_id == doc), key=lambda r: r.start))
        assert np.frombuffer(own, dtype="<u4").tolist() == both[1].encode(text, add_special_tokens=False).ids + [1]


def test_empty_table(documents):
    assert pack_documents(documents([]), PATH).collect() == []


def test_combinations_fill_a_window():
    brute = {(a, b, c) for a in range(13) for b in range(13) for c in range(13) if a >= b >= c and a + b + c == 12}
    assert {tuple(w) for w in combinations(12).tolist()} == brute


def test_repeat_counts_meet_an_exact_histogram():
    """Where whole windows explain the histogram, nothing is left."""
    ways = combinations(16)
    draw = np.random.default_rng(3)
    used = np.zeros(len(ways))
    used[draw.choice(len(ways), 6, replace=False)] = draw.integers(10, 60, 6)
    counts = np.bincount(ways.ravel(), weights=np.repeat(used, 3), minlength=17)
    counts[0] = 0
    solved = repeat_counts(ways, counts)
    met = np.bincount(ways.ravel(), weights=np.repeat(solved, 3), minlength=17)
    met[0] = 0
    assert (solved >= 0).all() and np.abs(met - counts).max() < 0.6


def test_every_step_is_placed_once():
    r = random.Random(7)
    for _ in range(60):
        full = r.choice([8, 24, 40])
        counts = np.array([0] + [r.choice([0, 0, 1, 3, 200]) for _ in range(full)], dtype=np.int64)
        places = plan(counts, r.choice([1, 3]))
        steps, filled = {}, {}
        for p in places:
            end = p.end or p.kind
            for k in range(p.count):
                steps.setdefault((p.kind, p.first + k), []).append((p.start, end))
                filled[p.sequence + k] = filled.get(p.sequence + k, 0) + end - p.start
        assert {k: sum(1 for kind, _ in steps if kind == k) for k in range(1, full + 1) if counts[k]} == {
            k: int(counts[k]) for k in range(1, full + 1) if counts[k]
        }
        for (kind, _), parts in steps.items():
            at = 0
            for low, high in sorted(parts):
                assert low == at
                at = high
            assert at == kind
        assert all(v <= full for v in filled.values())
        assert sorted(filled) == list(range(len(filled)))


def test_huge_counts_cost_no_more():
    counts = np.zeros(513, dtype=np.int64)
    counts[[3, 375, 200, 17]] = [10**9, 10**9, 7 * 10**8, 10**7]
    places = plan(counts, 8)
    total = int((counts * np.arange(513)).sum())
    assert len(places) < 3000 and max(p.sequence + p.count for p in places) * 512 < 1.01 * total
