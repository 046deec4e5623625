import math
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from evidentia.functions import markdown as md
from evidentia.operators import html, ingest as op, validation
from evidentia.operators.embedding import HashingEmbedder
from evidentia.plans import ingest as job
from evidentia.sources.markdown import read_markdown
from evidentia.sources import tables

HEADER = "---\nid: a\ntitle: 'A: b'\ntags:\n- x\n  - y\nvisibility: public\nconfidence: confirmed\ntype: faq\n---\n"


def brute_chunks(paragraphs, limit):
    out, buf = [], None
    for p in paragraphs:
        if buf is None:
            buf = p
        elif len(buf) + len(p) + 2 <= limit:
            buf += "\n\n" + p
        else:
            out.append(buf)
            buf = p
    return out + ([buf] if buf is not None else [])


def files(spark, rows):
    return spark.createDataFrame(rows, "source_id string, text string")


def test_front_matter(spark):
    rows = [("k/a.md", HEADER + "body"), ("k/b.md", "---\nid: b\nno end"), ("k/c.md", "text"), ("k/d.md", "---\nid: 1\nid: 2\ntags: [a, b]\n---")]
    got = {
        r.source_id: r
        for r in op.parse_files(files(spark, rows)).select("source_id", "header", "body", md.meta_map(F.col("meta")).alias("m")).collect()
    }
    assert got["k/a.md"].m == {
        "id": ["a"], "title": ["A: b"], "tags": ["x", "y"], "visibility": ["public"], "confidence": ["confirmed"], "type": ["faq"],
    }
    assert got["k/a.md"].body == "body"
    assert got["k/b.md"].header is None and got["k/b.md"].body == "---\nid: b\nno end"
    assert got["k/c.md"].m == {}
    assert got["k/d.md"].m == {"id": ["2"], "tags": ["[a, b]"]}


def test_slug(spark):
    rows = [("knowledge/projects/DataREADME.md", "x"), ("knowledge/notes/a.md", "x"), ("knowledge/projects/b.md", "---\nproject_slug: c\n---\nx")]
    got = {r.source_id: r.project_slug for r in op.infer_slug(op.parse_files(files(spark, rows))).collect()}
    assert got == {"knowledge/projects/DataREADME.md": "Data", "knowledge/notes/a.md": None, "knowledge/projects/b.md": "c"}


def test_packing_and_sections(spark):
    paragraphs = ["a" * 30, "b" * 30, "c" * 100, "d" * 5, "e" * 60]
    df = spark.createDataFrame([(paragraphs,)], "p array<string>")
    for limit in (50, 62, 100, 500):
        assert df.select(md.pack_paragraphs(F.col("p"), limit)).first()[0] == brute_chunks(paragraphs, limit)
    body = "lost\n\n## One\n\n" + "x" * 60 + "\n\n## Two\n" + "句子。" * 300
    got = spark.createDataFrame([(body,)], "b string").select(md.chunks_of(F.col("b"), F.lit("main")).alias("c")).first().c
    assert got[0].section == "main > One" and got[0].content == "x" * 60
    assert {c.section for c in got[1:]} == {"main > Two"}
    assert all(len(c.content) <= 500 for c in got) and "".join(c.content for c in got[1:]) == "句子。" * 300
    long = "w" * 700
    whole = spark.createDataFrame([(long,)], "b string").select(md.chunks_of(F.col("b"), F.lit("")).alias("c")).first().c
    assert [c.content for c in whole] == [long]


def test_chunking_is_linear_in_the_text(spark):
    body = "\n\n".join(f"paragraph {k} with some words" for k in range(30_000))
    df = spark.createDataFrame([("## One\n" + body,)], "b string")
    (got,) = df.select(md.chunks_of(F.col("b"), F.lit("")).alias("c")).first()
    assert "\n\n".join(c.content for c in got) == body


def test_validation(spark):
    rows = [
        ("k/1.md", HEADER + "body"), ("k/2.md", HEADER), ("k/3.md", "no header"), ("k/4.md", "---\n---\n"),
        ("k/5.md", "---\nid: b\ntype: odd\nvisibility: none\nconfidence: maybe\n---\nx"),
    ]
    got = {(r.source_id, r.level, r.rule, r.detail) for r in validation.validate_corpus(files(spark, rows)).collect()}
    assert got == {
        ("k/2.md", "error", "id_repeated", "a k/1.md"), ("k/2.md", "warning", "body_empty", ""),
        ("k/3.md", "error", "header", "missing"), ("k/4.md", "error", "header", "empty"),
        ("k/5.md", "error", "required", "title"), ("k/5.md", "warning", "type", "odd"),
        ("k/5.md", "error", "visibility", "none"), ("k/5.md", "error", "confidence", "maybe"),
    }
    report = validation.validation_report(validation.validate_corpus(files(spark, rows[:1]))).first()
    assert report.passed and report.errors == 0


def test_incremental_ingest(spark, tmp_path):
    root = tmp_path / "knowledge"
    text = "word " * 30
    for name, value in {"projects/p1.md": text, "notes/n1.md": text, "data/skip.md": text, "notes/short.md": "tiny"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(value, encoding="utf-8")
    (root / "notes" / "bad.md").write_bytes(b"\xff\xfe\x00bad")
    entities = spark.createDataFrame([(7, "p1")], "entity_id long, slug string")
    target = str(tmp_path / "snapshot")

    first = job.run_ingest(read_markdown(spark, str(root)), entities, target).first()
    assert (first.files_scanned, first.files_processed, first.files_skipped_filter, first.errors) == (5, 2, 2, 1)
    documents, chunks, version = job.stored(spark, target)
    assert version == 2 and {(r.source_id, r.project_id) for r in documents.collect()} == {
        ("knowledge/projects/p1.md", 7), ("knowledge/notes/n1.md", None),
    }
    assert chunks.where(F.size("embedding") == 64).count() == 2

    again = job.run_ingest(read_markdown(spark, str(root)), entities, target, dry_run=True).first()
    assert (again.files_skipped_hash, again.files_processed) == (2, 1)
    (root / "notes" / "n1.md").unlink()
    (root / "projects" / "p1.md").write_text("other " * 30, encoding="utf-8")
    moved = spark.createDataFrame([(8, "p1")], "entity_id long, slug string")
    third = job.run_ingest(read_markdown(spark, str(root)), moved, target).first()
    assert (third.docs_deleted, third.files_processed, third.chunks_new) == (1, 1, 1)
    documents, chunks, version = job.stored(spark, target)
    assert version == 3 and [(r.source_id, r.project_id) for r in documents.collect()] == [("knowledge/projects/p1.md", 8)]
    assert chunks.first().content.startswith("other")


def test_no_orphans_when_nothing_processed(spark):
    stored = spark.createDataFrame([("a",), ("b",)], "source_id string")
    kept, _, orphans = op.drop_orphans(stored, stored, stored.where("false"))
    assert kept.count() == 2 and orphans.count() == 0


def test_html(spark):
    page = (
        "<p onclick='x'>Hi <b>there</b> & <a href='javascript:x' title='t'>l</a><a href='https://e.example/?a=1&b=2'>k</a>"
        "<!-- c --><script>alert(1)</script><br><ul><li>one</ul>"
    )
    df = spark.createDataFrame([(page,), (None,)], "html string")
    clean = [r.clean for r in html.sanitize_pages(df).collect()]
    assert clean[0] == (
        "<p>Hi there &amp; <a title=\"t\">l</a><a href=\"https://e.example/?a=1&amp;b=2\">k</a>alert(1)<br><ul><li>one</li></ul></p>"
    )
    assert clean[1] == ""


def test_golden_checks(spark, tmp_path):
    path = tmp_path / "golden.json"
    path.write_text('[{"id": "1", "category": "c", "question": "q", "expected_sources": ["a"]}, {"id": "1", "category": "c", "question": "q", "expected_sources": []}]')
    golden = tables.read_golden(spark, str(path))
    assert {(r.id, r.rule) for r in validation.check_golden(golden).collect()} == {("1", "id_repeated"), ("1", "no_source")}


def test_chunk_options(spark):
    body = "before the first heading, long enough to stay as a chunk of its own\n\n## One\n\n" + "y" * 60
    df = spark.createDataFrame([(body, "句子。" * 300)], "b string, flat string")
    got = df.select(
        md.chunks_of(F.col("b"), F.lit("main")).alias("cut"), md.chunks_of(F.col("b"), F.lit("main"), keep_preamble=True).alias("kept"),
        md.chunks_of(F.col("flat"), F.lit("")).alias("whole"), md.chunks_of(F.col("flat"), F.lit(""), split_long_always=True).alias("split"),
    ).first()
    assert [c.section for c in got.cut] == ["main > One"] and [c.section for c in got.kept] == ["main", "main > One"]
    assert len(got.whole) == 1 and len(got.split) == 2 and "".join(c.content for c in got.split) == "句子。" * 300


def test_catalogue_is_cleared_or_merged(spark):
    schema = "slug string, title string, content_html string, related_links array<struct<label:string,url:string>>"
    old = spark.createDataFrame([("a", "old a", "<p>a</p>", []), ("b", "old b", "<p>b</p>", [])], schema)
    new = spark.createDataFrame([("a", "new a", "<p>a</p><script>x</script>", [("l", "javascript:x")])], schema)
    merged = {r.slug: (r.title, r.related_links) for r in tables.load_catalogue(old, new).collect()}
    assert merged == {"a": ("new a", []), "b": ("old b", [])}
    assert [r.slug for r in tables.load_catalogue(old, new, clear=True).collect()] == ["a"]
    assert [r.slug for r in tables.load_catalogue(None, new).collect()] == ["a"]


def test_documents_without_a_slug_do_not_meet_in_one_task(spark):
    """A table of entities that is not broadcast: null slugs match nothing, so they need no common task."""
    documents = spark.range(400).select(
        F.concat(F.lit("k/"), F.col("id").cast("string")).alias("source_id"),
        F.when(F.col("id") < 6, F.element_at(F.array(*map(F.lit, ("s1", "s1", "s2", "none", "", "s25000"))), (F.col("id") + 1).cast("int"))).alias("project_slug"),
    )
    # No union or local rows: the optimizer sees through this plan, and a constant key would be lost.
    n = F.col("id")
    slug = F.when(n == 25_001, "s2").when(n == 25_002, F.lit(None)).when(n == 25_003, "").otherwise(F.concat(F.lit("s"), n.cast("string")))
    entities = spark.range(25_004).select(slug.alias("slug"), n.alias("entity_id"))
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        linked = op.link_entities(documents, entities)
        assert linked.columns == ["project_slug", "source_id", "project_id", "unmatched_slug"]
        rows = linked.withColumn("task", F.spark_partition_id()).collect()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    found = sorted((r.source_id, r.project_slug, r.project_id, r.unmatched_slug) for r in rows if r.project_slug is not None)
    assert found == [
        ("k/0", "s1", 1, False), ("k/1", "s1", 1, False), ("k/2", "s2", 2, False), ("k/2", "s2", 25001, False),
        ("k/3", "none", None, True), ("k/4", "", 25003, False), ("k/5", "s25000", 25000, False),
    ]
    bare = [r for r in rows if r.project_slug is None]
    assert len(bare) == 394 and all(r.project_id is None and not r.unmatched_slug for r in bare)
    assert len({r.task for r in bare}) > 1


def test_embedded_words_add_up(spark):
    texts = ["the cat the CAT 中文", "", None, "...", "a-b_c 12 中"]
    for dimensions, seed in ((64, 0), (5, 3)):
        found = HashingEmbedder(dimensions, seed).embed(texts)
        for text, row in zip(texts, found):
            plain = [0.0] * dimensions
            for word in re.findall(r"[0-9a-z]+|[一-鿿]", (text or "").lower()):
                code = zlib.crc32(word.encode(), seed)
                plain[code % dimensions] += 1 if code & 0x80000000 else -1
            length = math.sqrt(sum(x * x for x in plain))
            assert np.allclose(row, [x / (length or 1) for x in plain], atol=1e-12)
    assert HashingEmbedder().embed([]).shape == (0, 64)
