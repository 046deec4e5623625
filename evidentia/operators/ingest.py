"""Corpus ingest: metadata, change detection, chunk emission, snapshot maintenance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from evidentia import fixed_values as fixed
from evidentia.functions import markdown as md
from evidentia.functions.text import strip
from evidentia.operators.skew import salted_join
from evidentia.session import broadcast_if_small


def _path(c: Column) -> Column:
    return F.split(c, "/", -1)


def file_stem(c_path: Column) -> Column:
    return F.regexp_replace(F.element_at(_path(c_path), -1), r"(?<=.)\.[^.]*\z", "")


def content_hash(c_text: Column) -> Column:
    return F.sha2(c_text, 256)


def parse_files(files: DataFrame) -> DataFrame:
    """``source_id, text`` → plus ``header, body, meta``.

    Both steps go through a generator of one row, so that a later filter on the
    metadata is not rewritten into the scan, where it would parse whole texts again.
    """
    split = files.select(*files.columns, F.inline(F.array(md.split_front_matter(F.col("text")))))
    meta = F.struct(md.parse_front_matter(F.col("header")).alias("meta"))
    return split.select(*split.columns, F.inline(F.array(meta)))


def filter_sources(parsed: DataFrame, skipped: Sequence[str] = fixed.SKIPPED_FOLDERS) -> DataFrame:
    return parsed.where(~is_filtered(skipped))


def is_filtered(skipped: Sequence[str] = fixed.SKIPPED_FOLDERS) -> Column:
    parts = _path(F.col("source_id"))
    in_skipped = (F.size(parts) > 2) & F.get(parts, F.lit(1)).isin(*skipped)
    private = F.coalesce(md.meta_value(F.col("meta"), "visibility") == "private", F.lit(False))
    return in_skipped | private


def default_meta(parsed: DataFrame) -> DataFrame:
    """Metadata columns with their defaults: ``doc_key, title, document_type, visibility, confidence, tags, doc_section``."""
    meta = F.col("meta")
    value = lambda key: md.meta_value(meta, key)
    tags = md.meta_entry(meta, "tags")
    # A value written on one line is text, not a list: it reaches the text that is
    # embedded, but not the tags column.
    return parsed.select(
        "*",
        F.coalesce(value("id"), file_stem(F.col("source_id"))).alias("doc_key"),
        F.coalesce(value("title"), md.first_heading(F.col("body")), file_stem(F.col("source_id"))).alias("title"),
        F.coalesce(value("type"), F.lit(fixed.HEADER_DEFAULTS["type"])).alias("document_type"),
        F.coalesce(value("visibility"), F.lit(fixed.HEADER_DEFAULTS["visibility"])).alias("visibility"),
        F.coalesce(value("confidence"), F.lit(fixed.HEADER_DEFAULTS["confidence"])).alias("confidence"),
        F.when(tags["is_list"], tags["values"]).otherwise(F.array().cast("array<string>")).alias("tags"),
        F.coalesce(tags["values"], F.array().cast("array<string>")).alias("embed_tags"),
        F.coalesce(value("section"), F.lit("")).alias("doc_section"),
    )


def infer_slug(parsed: DataFrame, root: str = "knowledge") -> DataFrame:
    """``project_slug``: from the header, else from the name of a file under ``<root>/projects``."""
    given = md.meta_value(F.col("meta"), "project_slug")
    parts = _path(F.col("source_id"))
    in_projects = (F.size(parts) >= 3) & (F.get(parts, F.lit(0)) == root) & (F.get(parts, F.lit(1)) == "projects")
    return parsed.withColumn(
        "project_slug",
        F.when(F.coalesce(given, F.lit("")) != "", strip(given)).when(
            in_projects, F.regexp_replace(file_stem(F.col("source_id")), r"(?i)readme\z", "")
        ),
    )


def link_entities(documents: DataFrame, entities: DataFrame) -> DataFrame:
    """Adds ``project_id``; ``unmatched_slug`` marks a slug no entity has.

    Documents without a slug, often most of them, match nothing; beside a large table of entities they are
    spread over the tasks instead of meeting in the one of the null key.
    """
    known = entities.select(F.col("slug").alias("project_slug"), F.col("entity_id").alias("project_id"), F.xxhash64("slug").alias("_spread"))
    # Not a constant, which the optimizer would take out of the join's keys.
    spread = documents.withColumn("_spread", F.xxhash64(F.coalesce("project_slug", "source_id")))
    linked = spread.join(broadcast_if_small(known), ["project_slug", "_spread"], "left").drop("_spread")
    return linked.withColumn("unmatched_slug", (F.coalesce("project_slug", F.lit("")) != "") & F.col("project_id").isNull())


def classify_changes(incoming: DataFrame, existing: DataFrame, force: bool = False) -> DataFrame:
    """Adds ``change``: new, changed, relink (same content, other entity) or unchanged."""
    stored = existing.select(
        "source_id", F.col("content_hash").alias("_hash"), F.col("project_id").alias("_link"),
        F.lit(True).alias("_known"),
    )
    known = F.coalesce("_known", F.lit(False))
    same = known & F.col("content_hash").eqNullSafe(F.col("_hash")) & F.lit(not force)
    moved = F.col("project_id").isNotNull() & ~F.col("project_id").eqNullSafe(F.col("_link"))
    return (
        incoming.join(stored, "source_id", "left")
        .withColumn(
            "change",
            F.when(same & moved, "relink").when(same, "unchanged").when(known, "changed").otherwise("new"),
        )
        .drop("_hash", "_link", "_known")
    )


def chunk_documents(documents: DataFrame, **options) -> DataFrame:
    """One row per chunk, numbered in document order. Needs no shuffle.

    ``token_count`` is the number of characters.
    """
    pieces = md.chunks_of(F.col("body"), F.col("doc_section"), **options)
    kept = [c for c in documents.columns if c not in ("text", "header", "body", "meta", "content_hash")]
    return (
        documents.select(*kept, F.posexplode(pieces).alias("chunk_index", "_piece"))
        .withColumn("section", F.col("_piece.section"))
        .withColumn("content", F.col("_piece.content"))
        .drop("_piece")
        .withColumn("token_count", F.length("content"))
        .withColumn("chunk_id", F.sha2(F.concat_ws("#", "source_id", F.col("chunk_index").cast("string")), 256))
        .withColumn(
            "embed_text",
            md.embed_text(
                F.col("title"),
                F.when(F.col("section") != "", F.col("section")).otherwise(F.col("doc_section")),
                F.col("embed_tags"), F.col("content"),
            ),
        )
    )


def orphans(documents: DataFrame, processed: DataFrame) -> DataFrame:
    """Documents no longer processed; none when nothing was processed.

    Only one flag row about ``processed`` meets the stored documents, as an equi-join on the flag.
    """
    any_processed = processed.agg((F.count("*") > 0).alias("_active"))
    gone = documents.join(processed.select("source_id").distinct(), "source_id", "left_anti")
    return gone.withColumn("_active", F.lit(True)).join(F.broadcast(any_processed), "_active", "left_semi").drop("_active")


def drop_orphans(documents: DataFrame, chunks: DataFrame, processed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(documents, chunks, orphans)`` after removing documents no longer processed."""
    gone = orphans(documents, processed)
    ids = gone.select("source_id")
    return (
        documents.join(ids, "source_id", "left_anti"),
        chunks.join(ids, "source_id", "left_anti"),
        gone,
    )


def upsert(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """Rows of ``source`` replace rows of ``target`` with the same key; others are kept."""
    marked = source.select(*target.columns)
    kept = target.join(marked.select(key), key, "left_anti")
    return kept.unionByName(marked)


def replace_chunks(chunks: DataFrame, new: DataFrame, touched: DataFrame) -> DataFrame:
    """Chunks with those of touched documents exchanged for ``new``."""
    return chunks.join(touched.select("source_id").distinct(), "source_id", "left_anti").unionByName(
        new.select(*chunks.columns)
    )


def relink(documents: DataFrame, chunks: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sets ``project_id`` of the documents in ``links(source_id, project_id)`` and of their chunks."""
    wanted = links.select("source_id", F.col("project_id").alias("_link"))

    def linked(df: DataFrame, join) -> DataFrame:
        return join(df).withColumn("project_id", F.coalesce("_link", "project_id")).select(*df.columns)

    return (
        linked(documents, lambda df: df.join(wanted, "source_id", "left")),
        linked(chunks, lambda df: salted_join(df, wanted, ["source_id"], ["chunk_id"], "left")),
    )


def backfill_links(
    documents: DataFrame, chunks: DataFrame, entities: DataFrame, folder: str = "knowledge/projects"
) -> tuple[DataFrame, DataFrame]:
    """Links unlinked documents by file name, then brings their chunks in line."""
    keys = entities.select(
        F.col("entity_id").alias("_link"),
        F.explode(
            F.array(
                F.lower(F.concat(F.lit(f"{folder}/"), "slug", F.lit(".md"))),
                F.lower(F.concat(F.lit(f"{folder}/"), "slug", F.lit("README.md"))),
            )
        ).alias("_path"),
    )
    linked = (
        documents.withColumn("_path", F.lower("source_id"))
        .join(broadcast_if_small(keys), "_path", "left")
        .withColumn("project_id", F.coalesce("project_id", "_link"))
        .select(*documents.columns)
    )
    owners = linked.where(F.col("project_id").isNotNull()).select("source_id", F.col("project_id").alias("_owner"))
    aligned = (
        salted_join(chunks, owners, ["source_id"], ["chunk_id"], "left")
        .withColumn("project_id", F.coalesce("_owner", "project_id"))
        .select(*chunks.columns)
    )
    return linked, aligned


def ingest_report(classified: DataFrame, chunk_counts: DataFrame, n_deleted: DataFrame, dry_run: bool = False) -> DataFrame:
    """One row of counts.

    ``classified``: one row per scanned file with ``read_error, filtered, change``.
    ``chunk_counts``: ``source_id, n_chunks`` of processed files. ``n_deleted``: one
    row ``docs_deleted``.
    """
    ok = ~F.col("read_error") & ~F.col("filtered")
    handled = ok & F.col("change").isin("new", "changed")
    n = F.coalesce("n_chunks", F.lit(0))
    empty = handled & (n == 0) & F.lit(not dry_run)
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    report = classified.join(chunk_counts, "source_id", "left").agg(
        F.count("*").alias("files_scanned"),
        (count(~F.col("read_error") & F.col("filtered")) + count(empty)).alias("files_skipped_filter"),
        count(ok & F.col("change").isin("unchanged", "relink")).alias("files_skipped_hash"),
        count(handled & ~empty).alias("files_processed"),
        (F.lit(0).cast("long") if dry_run else F.coalesce(F.sum(F.when(handled, n)), F.lit(0)).cast("long")).alias("chunks_new"),
        (F.lit(0).cast("long") if dry_run else count(ok & (F.col("change") == "relink"))).alias("links_updated"),
        count(F.col("read_error")).alias("errors"),
    )
    deleted = n_deleted.select(F.when(F.lit(dry_run), F.lit(0)).otherwise(F.col("docs_deleted")).cast("long").alias("docs_deleted"), F.lit(1).alias("_one"))
    return report.withColumn("_one", F.lit(1)).join(deleted, "_one").drop("_one")
