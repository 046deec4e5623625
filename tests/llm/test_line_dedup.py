import random

import pytest

from evidentia.llm.line_dedup import cut, deduplicated, kept_lines, keyed, line_bitmaps, line_key, with_bitmaps


def brute(docs):
    holders = {}
    for doc, text in docs:
        for line in (text or "").split("\n"):
            key = line_key(line.encode()).decode()
            if len(key) >= 10:
                holders.setdefault(key, set()).add(2**63 if doc is None else doc)
    out = []
    for doc, text in docs:
        lines, own = (text or "").split("\n"), 2**63 if doc is None else doc
        keys = [line_key(line.encode()).decode() for line in lines]
        out.append((doc, "\n".join(line for line, k in zip(lines, keys) if len(holders.get(k, ())) < 2 or min(holders[k]) == own)))
    return sorted(out, key=str)


def shortened(docs):
    rows = with_bitmaps(keyed(docs), line_bitmaps(keyed(docs))).collect()
    return sorted(((r.doc_id, cut(r.text, r.bitmap)[0]) for r in rows), key=str)


def fixture(seed):
    r = random.Random(seed)
    pool = [f"a shared line number {k}" for k in range(12)] + ["short", "", "  Padded SHARED line\t", "padded shared line", "ééééééééé", "éééééééééé"]
    docs = [(k, "\n".join(r.choice(pool) for _ in range(r.randint(0, 9)))) for k in r.sample(range(1000), 120)]
    return docs + [(None, "a shared line number 1"), (None, "another one for null"), (7000, None), (7001, ""), (7002, "\n\n"), (3, "a shared line number 1")]


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_lines_match_brute_force(spark, documents, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        docs = fixture(partitions)
        assert shortened(documents(docs)) == brute(docs)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_one_line_in_every_document_spreads_over_tasks(spark, documents):
    docs = [(k, f"the same line everywhere\nown line of {k} alone") for k in range(600)]
    assert shortened(documents(docs, parts=8)) == brute(docs)


def test_repeated_rows_keep_the_same_lines(documents):
    docs = [(1, "some shared line"), (1, "some shared line"), (2, "some shared line\nx"), (2, "other text here")]
    assert shortened(documents(docs)) == [(1, "some shared line")] * 2 + [(2, "other text here"), (2, "x")]


def test_columns_are_kept_and_names_do_not_clash(spark):
    docs = spark.createDataFrame([(1, "some shared line", "a", 5), (2, "some shared line\nb", None, None), (3, None, "c", 1)], "doc_id long, text string, _bitmap string, _ID int")
    found = deduplicated(docs)
    assert found.schema == docs.schema
    assert sorted(map(tuple, found.collect())) == [(1, "some shared line", "a", 5), (2, "b", None, None), (3, None, "c", 1)]


def test_bitmaps_are_small_and_decode(documents):
    docs = [(1, "\n".join(["a line that repeats"] * 5000)), (2, "\n".join(["a line that repeats"] * 5000) + "\nlast")]
    (row,) = line_bitmaps(keyed(documents(docs))).collect()
    assert row.doc_id == 2 and len(row.bitmap) < 100
    assert kept_lines(row.bitmap, 5001).tolist() == [False] * 5000 + [True]


def test_empty_table(documents):
    assert line_bitmaps(keyed(documents([]))).collect() == []
