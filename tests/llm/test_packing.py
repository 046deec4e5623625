import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given as drawn, settings, strategies as st
from tokenizers import Tokenizer

from evidentia.llm.packing import pack_documents, sequences, two_fit
from evidentia.llm.word_bpe import word_bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def both():
    with open(PATH, encoding="utf-8") as file:
        spec = file.read()
    return word_bpe(spec), Tokenizer.from_str(spec)


def ids(fast, text):
    return np.frombuffer(fast.ids(text.encode()), dtype="<u4").tolist()


def test_ids_are_the_tokenizers_own(both, given):
    fast, exact = both
    odd = ["<|endoftext|>", "a<|endoftext|>b <|startoftext|> x", "it's we'll I'M DON'T", "ǅ ǆ Ǆ ŉ ẞ İ", "a\x1cb\x85c　d", "é ́", "", " \n"]
    for text in odd + [t or "" for _, t in given]:
        assert ids(fast, text) == exact.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@drawn(st.text(alphabet="aAbzé'Éßøı ΣςŁ́ñ \t\n\x0b\x1c.,!?-_#&|<>0123漢字😀ﬁ½²ªº×÷ſsthe", max_size=40))
def test_ids_of_any_text(both, text):
    fast, exact = both
    assert ids(fast, text) == exact.encode(text, add_special_tokens=False).ids


def check(found, docs, exact, capacity):
    expected = []
    for doc, text in docs:
        own = exact.encode(text or "", add_special_tokens=False).ids + [0]
        for n, low in enumerate(range(0, len(own), capacity)):
            part = own[low : low + capacity]
            expected.append((doc, n, low, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes())))
    rows = found.collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=str) == sorted(expected, key=str)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), -(-sum(r.length for r in rows) // capacity)


def test_pieces_and_places(both, documents, given):
    docs = given + [(900, None), (901, ""), (None, "hello world"), (5, "again"), (5, "again"), (902, "word " * 9000)]
    bins, least = check(pack_documents(documents(docs), PATH), docs, both[1], 2048)
    assert bins <= least + 2


def test_one_length_is_a_third_of_all(both, documents):
    docs = [(k, "one two three four" if k % 3 else "five " * (k % 40)) for k in range(600)]
    bins, least = check(pack_documents(documents(docs, parts=8), PATH, capacity=64), docs, both[1], 64)
    assert bins <= least + 2


def test_empty_table(documents):
    assert pack_documents(documents([]), PATH).collect() == []


def test_sequences_hold_the_ids(both, documents):
    docs = [(k, "some words " * (k % 7)) for k in range(30)]
    packed = pack_documents(documents(docs), PATH, capacity=32, with_ids=True)
    total = b"".join(bytes(r.ids) for r in sequences(packed).collect())
    assert len(total) // 4 == sum(len(both[1].encode(t, add_special_tokens=False).ids) + 1 for _, t in docs)


def test_two_fit_replaces_the_smallest():
    """Greedy takes 6 and 2 of 10; two documents of 2 fill the expanded gap of 4 better than one."""
    counts = np.zeros(11, dtype=np.int64)
    counts[[6, 3]] = 1
    counts[2] = 2
    assert [sorted(b.lengths) for b in two_fit(counts, 10)] == [[2, 2, 6], [3]]


def test_every_document_is_packed_once():
    r = random.Random(4)
    for _ in range(50):
        counts = np.array([0] + [r.choice([0, 0, 1, 2, 50]) for _ in range(40)], dtype=np.int64)
        used = np.zeros_like(counts)
        for filling in two_fit(counts, 40):
            assert sum(filling.lengths) <= 40 and filling.times > 0
            for length in filling.lengths:
                used[length] += filling.times
        assert (used == counts).all()
