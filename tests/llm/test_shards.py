import zlib
from collections import Counter

from evidentia.llm.shards import interleave, write_shards


def test_equal_counts_and_mixture(spark, documents):
    rows = [(k, f"text {k}", None, "big" if k % 3 == 0 else f"s{k % 7}") for k in range(500)]
    found = interleave(documents(rows), n_shards=8).collect()
    assert len(found) == 500
    counts = Counter(r.shard for r in found)
    assert set(counts) == set(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    for shard in range(8):
        assert sorted(r.slot for r in found if r.shard == shard) == list(range(counts[shard]))
    for source, total in Counter(r.source for r in found).items():
        for shard in range(8):
            share = sum(r.shard == shard and r.source == source for r in found)
            assert abs(share - total / 8) <= 1.5


def test_bytes_and_checksums(documents):
    rows = [(0, None), (1, ""), (2, "é漢"), (None, "x"), (5, "same"), (5, "same")]
    found = interleave(documents(rows), n_shards=3).collect()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in found) == sorted(
        (str(d), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows
    )
    assert sorted((r.shard, r.slot) for r in found) == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 0), (2, 1)]


def test_the_seed_decides_not_the_partitions(documents):
    rows = [(k, "t", None, f"s{k % 3}") for k in range(100)]
    places = lambda df, seed=17: {r.doc_id: (r.shard, r.slot) for r in interleave(df, seed=seed).collect()}
    assert places(documents(rows, parts=1)) == places(documents(rows, parts=5))
    assert places(documents(rows)) != places(documents(rows), seed=18)


def test_fewer_rows_than_shards_and_none(documents):
    assert len({r.shard for r in interleave(documents(["a", "b", "c"]), n_shards=8).collect()}) == 3
    assert interleave(documents([])).collect() == []


def test_written_shards_hold_the_rows_in_order(spark, documents, tmp_path):
    docs = documents([(k, f"t{k}", None, "s") for k in range(40)])
    assigned = interleave(docs, n_shards=4).cache()
    write_shards(docs, assigned, str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == 40
    first = [r.slot for r in spark.read.parquet(str(tmp_path / "shards/shard=2")).collect()]
    assert sorted(first) == list(range(10))


def test_no_python_in_the_plan(documents):
    plan = interleave(documents(["a", "b"]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
