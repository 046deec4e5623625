"""The bucketed store, and the jobs that write to it in proportion to what changes."""

import os
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from evidentia.operators import conversations as cv
from evidentia.plans import ingest as job
from evidentia.plans.retention import create_store, retention_job
from evidentia.sources import bucketed
from evidentia.sources.bucketed import Change
from evidentia.streaming.tables import compact_rollup, read_rollup, stream_rollup

NOW = datetime(2024, 5, 1, tzinfo=timezone.utc)
ROW = "owner long, part int, value string"


def size(root, version=None):
    """Bytes of data files, of one version or of all."""
    total = 0
    for folder, _, names in os.walk(root):
        if version is None or f"_version={version}" in folder.split(os.sep):
            total += sum(os.path.getsize(os.path.join(folder, n)) for n in names if n.endswith(".parquet"))
    return total


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_commits_equal_a_dictionary(spark, tmp_path):
    """Random replacements and removals, folded now and then, against a dictionary; old versions stay readable."""
    root, r = str(tmp_path / "store"), random.Random(3)
    bucketed.create(spark, root, {"t": ("owner", ROW), "u": ("owner", ROW)}, buckets=4)
    held, past = {}, {}
    for step in range(6):
        changed = {o: [(o, k, f"{step}") for k in range(r.randint(1, 3))] for o in r.sample(range(30), r.choice([1, 4, 12]))}
        removed = [o for o in r.sample(range(30), 3) if o not in changed]
        held.update(changed)
        for o in removed:
            held.pop(o, None)
        new = spark.createDataFrame([x for part in changed.values() for x in part], ROW)
        version = bucketed.commit(spark, root, {"t": Change(new, spark.createDataFrame([(o,) for o in removed], "owner long"))})
        past[version] = sorted(x for part in held.values() for x in part)
    for version, expected in past.items():
        assert rows(bucketed.read(spark, root, "t", version)) == expected
    assert rows(bucketed.read(spark, root, "u")) == []
    some = bucketed.buckets_of(spark, root, "t", spark.createDataFrame([(5,)], "owner long"))
    assert len(some) == 1
    assert [x for x in rows(bucketed.read(spark, root, "t", buckets=some)) if x[0] == 5] == [x for x in past[version] if x[0] == 5]


def test_a_commit_that_died_has_no_effect(spark, tmp_path):
    root = str(tmp_path / "store")
    bucketed.create(spark, root, {"t": ("owner", ROW)}, buckets=2)
    bucketed.commit(spark, root, {"t": Change(spark.createDataFrame([(1, 0, "a")], ROW))})
    # Files of version 3 without a manifest, as a killed job leaves them.
    bucketed._layer(spark, root, bucketed.manifest(spark, root)["t"][0], Change(spark.createDataFrame([(1, 0, "lost")], ROW)), 3)
    assert rows(bucketed.read(spark, root, "t")) == [(1, 0, "a")]
    bucketed.commit(spark, root, {"t": Change(spark.createDataFrame([(2, 0, "b")], ROW))})
    assert rows(bucketed.read(spark, root, "t")) == [(1, 0, "a"), (2, 0, "b")]


def test_written_bytes_follow_the_change(spark, tmp_path):
    root = str(tmp_path / "store")
    bucketed.create(spark, root, {"t": ("owner", ROW)}, buckets=16)
    whole = spark.range(20_000).select(F.col("id").alias("owner"), F.lit(0).alias("part"), F.sha2(F.col("id").cast("string"), 512).alias("value"))
    first = bucketed.commit(spark, root, {"t": Change(whole)})
    second = bucketed.commit(spark, root, {"t": Change(spark.createDataFrame([(7, 0, "new")], ROW))})
    assert size(root, second) < size(root, first) / 500
    # A folded bucket is rewritten alone; the others keep their files.
    third = bucketed.commit(spark, root, {"t": Change(owners=spark.createDataFrame([(9,)], "owner long"))}, fold=0.0)
    lines = bucketed.manifest(spark, root)["t"]
    rewritten = {e.bucket for e in lines if e.kind == "base" and e.version == third}
    assert 1 <= len(rewritten) <= 2 and not [e for e in lines if e.kind == "layer"]
    assert bucketed.read(spark, root, "t").count() == 19_999
    plan = bucketed.read(spark, root, "t")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def conversation_tables(spark, n=400, seed=5):
    r = random.Random(seed)
    visitors = [(v, NOW + timedelta(days=r.choice([-1, 3])) if v % 7 == 0 else NOW + timedelta(days=9), NOW if v % 11 == 0 else None) for v in range(40)]
    convs = [(c, r.choice([None, *range(40)]), NOW - timedelta(days=r.choice([0, 5, 29, 31, 90])) if c % 9 == 0 else NOW) for c in range(n)]
    messages = [(c * 10 + k, c, k, f"text {c} {k}") for c in range(n) for k in range(r.randint(0, 4))]
    feedback = [(k, m[0] if k % 17 else None, r.choice([-1, 1])) for k, m in enumerate(messages) if k % 3 == 0]
    return {
        "visitors": spark.createDataFrame(visitors, "visitor_id long, expires_at timestamp, revoked_at timestamp"),
        "conversations": spark.createDataFrame(convs, "conversation_id long, visitor_id long, last_active_at timestamp"),
        "messages": spark.createDataFrame(messages, "message_id long, conversation_id long, sequence_no int, content string"),
        "feedback": spark.createDataFrame(feedback, "feedback_id long, message_id long, rating int"),
    }


def test_retention_equals_the_operator(spark, tmp_path):
    tables, root = conversation_tables(spark), str(tmp_path / "store")
    create_store(spark, root, tables, buckets=8)
    expected = cv.apply_retention(dict(tables), NOW, 30)
    report = retention_job(spark, root, NOW, 30).first()
    assert report.removed == expected.pop("removed").first().removed > 0
    for name, df in expected.items():
        assert rows(bucketed.read(spark, root, name).fillna(-1)) == rows(df.select(*tables[name].columns).fillna(-1)), name
        assert report[name] == tables[name].count() - df.count(), name
    version = bucketed.current_version(spark, root)
    again = retention_job(spark, root, NOW, 30).first()
    assert set(again) == {0} and bucketed.current_version(spark, root) == version


def test_retention_writes_what_it_removes(spark, tmp_path):
    """One old conversation of many: one tombstone, no bucket of messages rewritten, nothing but its buckets opened."""
    root = str(tmp_path / "store")
    n = 3000
    tables = {
        "visitors": spark.createDataFrame([], "visitor_id long, expires_at timestamp, revoked_at timestamp"),
        "conversations": spark.range(n).select(
            F.col("id").alias("conversation_id"), F.lit(None).cast("long").alias("visitor_id"),
            F.when(F.col("id") == 77, F.lit(NOW - timedelta(days=99))).otherwise(F.lit(NOW)).alias("last_active_at"),
        ),
        "messages": spark.range(n * 10).select(
            F.col("id").alias("message_id"), F.floor(F.col("id") / 10).alias("conversation_id"), F.sha2(F.col("id").cast("string"), 512).alias("content")
        ),
        "feedback": spark.range(0, n * 10, 5).select(F.col("id").alias("feedback_id"), F.col("id").alias("message_id")),
    }
    first = create_store(spark, root, tables, buckets=32)
    report = retention_job(spark, root, NOW, 30).first()
    assert tuple(report) == (1, 0, 1, 10, 2)
    lines = [e for part in bucketed.manifest(spark, root).values() for e in part if e.version == first + 1]
    assert all(e.kind == "layer" and e.rows == 0 for e in lines) and len(lines) <= 4
    assert size(root, first + 1) < size(root, first) / 100
    assert bucketed.read(spark, root, "messages").where("conversation_id = 77").count() == 0


def test_rollup_stream_equals_batch(spark, tmp_path):
    """Messages arrive in any order over several batches; late ones still count, and give the title."""
    schema = "message_id long, conversation_id long, sequence_no int, role string, content string, created_at timestamp"
    r = random.Random(2)
    messages = [
        (c * 10 + k, c, k, r.choice(["user", "assistant"]), f"says {c} {k}\nmore", NOW + timedelta(minutes=r.randint(0, 999)))
        for c in range(30) for k in range(r.randint(0, 6))
    ]
    r.shuffle(messages)
    convs = spark.createDataFrame([(c, None if c % 2 else "kept", NOW - timedelta(days=9), None) for c in range(31)],
                                  "conversation_id long, title string, last_message_at timestamp, message_count long")
    source, root = str(tmp_path / "in"), str(tmp_path / "rollup")
    for k in range(3):
        spark.createDataFrame(messages[k::3], schema).coalesce(1).write.mode("append").parquet(source)
        stream_rollup(spark.readStream.schema(schema).parquet(source), root, str(tmp_path / "checkpoint")).awaitTermination()
        if k == 1:
            compact_rollup(spark, root)
    columns = ["conversation_id", "title", "last_message_at", "message_count"]
    expected = cv.rollup_conversations(convs, spark.createDataFrame(messages, schema)).select(*columns)
    got = read_rollup(spark, root, convs).select(*columns)
    key = lambda row: row[0]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, expected.collect()), key=key)
    # A repeated batch writes the same folder again.
    assert len([d for d in os.listdir(f"{root}/delta") if d.startswith("batch=")]) == 3


@pytest.mark.parametrize("force", [False, True])
def test_ingest_writes_what_changed(spark, tmp_path, force):
    target = str(tmp_path / "store")
    entities = spark.createDataFrame([(1, "p3")], "entity_id long, slug string")
    first = [(f"knowledge/projects/p{k}.md", f"## Part\n\n{'alpha beta gamma ' * 20} {k}") for k in range(120)]
    schema = "source_id string, text string"
    job.run_ingest(spark.createDataFrame(first, schema), entities, target, buckets=8)
    base = bucketed.current_version(spark, target)
    second = [(s, t + " changed" if k == 5 else t) for k, (s, t) in enumerate(first) if k != 9]
    moved = spark.createDataFrame([(2, "p3")], "entity_id long, slug string")
    report = job.run_ingest(spark.createDataFrame(second, schema), moved, target, force=force).first()
    # With force every document is embedded anew.
    assert report.files_processed == (119 if force else 1) and report.docs_deleted == 1
    assert report.links_updated == (0 if force else 1)
    documents, chunks, version = job.stored(spark, target)
    assert version == base + 1 and documents.count() == 119
    assert {r.project_id for r in chunks.where("source_id like '%p3.md'").collect()} == {2}
    assert chunks.where("source_id like '%p9.md'").count() == 0
    assert chunks.where("source_id like '%p5.md'").first().content.endswith("changed")
    if not force:
        assert size(target, version) < size(target, base) / 4
