import random
import re

from evidentia.llm import common, phrase_index
from evidentia.llm.phrase_index import build_index, find_items

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def cut(text):
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window):
    out = []
    for doc, text in docs:
        own, hit, names = cut(text), set(), set()
        for item, passage in items:
            w = cut(passage)
            for low in range(max(1, len(w) - window + 1) if w else 0):
                part = w[low : low + window]
                for at in range(len(own) - len(part) + 1):
                    if own[at : at + len(part)] == part:
                        hit.update(range(at, at + len(part)))
                        names.add(str(item))
        out.append((doc, len(own), len(hit), sorted(names)))
    return sorted(out, key=str)


def rows(found):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in found.collect()), key=str)


def fixture(seed=1):
    r = random.Random(seed)
    text = lambda n: " ".join(r.choice("a b c d e É f-g h.i 9".split()) for _ in range(n))
    items = [(k, text(r.randint(0, 7))) for k in range(12)] + [(3, "a b c"), (None, "c b a"), (40, None), (41, "!!")]
    docs = [(k, text(r.randint(0, 60))) for k in range(60)]
    docs += [(5, "a b c"), (5, "a b c"), (None, "x a b c y"), (90, None), (91, ""), (92, "..."), (93, "A, b; C " * 3000)]
    return docs, items


def test_phrases_match_brute_force(spark, documents):
    docs, items = fixture()
    table = spark.createDataFrame(items, "item_id long, text string")
    found = rows(find_items(build_index(documents(docs)), table, window=4))
    assert found == brute(docs, [("" if k is None else k, t) for k, t in items], 4)


def test_slices_of_items_give_the_same(spark, documents, monkeypatch):
    docs, items = fixture(2)
    index = build_index(documents(docs))
    table = spark.createDataFrame(items, "item_id long, text string")
    whole = rows(find_items(index, table, window=4))
    monkeypatch.setattr(phrase_index, "SLICE_ITEMS", 3)
    assert rows(find_items(index, table, window=4)) == whole


def test_equal_blocks_stay_apart_over_slices(spark, monkeypatch):
    docs = [(k, "a b c d e") for k in range(5)] * 2
    monkeypatch.setitem(common._BATCHES, "spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    index = build_index(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1))
    items = spark.createDataFrame([(k, t) for k, t in enumerate(["a b c", "b c", "d e"])], "item_id long, text string")
    monkeypatch.setattr(phrase_index, "SLICE_ITEMS", 1)
    assert rows(find_items(index, items, window=3)) == brute(docs, items.collect(), 3) and index.count() == 2


def test_given_passages_with_the_window_of_ten(spark, documents, given):
    items = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("item_id", "text").collect()]
    table = spark.createDataFrame(items, "item_id long, text string")
    found = rows(find_items(build_index(documents(given)), table))
    assert found == brute(given, items, 10) and any(n for _, _, n, _ in found)


def test_proximity_finds_reordered_and_interrupted_windows(spark, documents):
    docs = [(0, "one two three"), (1, "three, uh, one two"), (2, "one " + "x " * 20 + "two three"), (3, "one two"), (4, "two three")]
    items = spark.createDataFrame([(7, "one two three")], "item_id long, text string")
    found = find_items(build_index(documents(docs, parts=1)), items, window=3, slack=2).collect()
    assert {r.doc_id: r.near for r in found} == {0: ["7"], 1: ["7"], 2: [], 3: [], 4: []}
    assert {r.doc_id: r["items"] for r in found} == {0: ["7"], 1: [], 2: [], 3: [], 4: []}


def test_no_items_and_no_documents(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    assert rows(find_items(build_index(documents([(1, "a b")])), none)) == [(1, 2, 0, [])]
    some = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert rows(find_items(build_index(documents([])), some)) == []
