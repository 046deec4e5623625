"""The ingest job: files in, new document and chunk snapshot out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from evidentia.operators import ingest as op
from evidentia.operators.embedding import Embedder, HashingEmbedder, embed
from evidentia.session import broadcast_if_small, cut_lineage
from evidentia.sources import bucketed, tables
from evidentia.sources.bucketed import Change

DOCUMENTS = (
    "source_id string, doc_key string, title string, document_type string, project_id long,"
    " content_hash string, visibility string, confidence string, tags array<string>"
)
CHUNKS = (
    "chunk_id string, source_id string, project_id long, chunk_index int, title string, section string,"
    " content string, visibility string, confidence string, tags array<string>, token_count int,"
    " embedding array<float>"
)

_CLASSIFIED = ("source_id", "read_error", "filtered", "content_hash", "project_id")


def describe(files: DataFrame, entities: DataFrame) -> DataFrame:
    """Every scanned file with its metadata and whether it is filtered."""
    if "read_error" not in files.columns:
        files = files.withColumn("read_error", F.lit(False))
    parsed = op.parse_files(files.withColumn("text", F.coalesce("text", F.lit(""))))
    described = op.infer_slug(op.default_meta(parsed.withColumn("filtered", op.is_filtered())))
    return op.link_entities(described.withColumn("content_hash", op.content_hash(F.col("text"))), entities)


def classify(files: DataFrame, documents: DataFrame, entities: DataFrame, force: bool = False) -> DataFrame:
    """What changed in every scanned file; no texts."""
    return op.classify_changes(describe(files, entities).select(*_CLASSIFIED), documents, force)


def plan_changes(
    files: DataFrame, documents: DataFrame, entities: DataFrame, chunks_of: Callable[[DataFrame], DataFrame],
    provider: Callable[[], Embedder] = HashingEmbedder, force: bool = False, partial: bool = False,
) -> tuple[dict[str, Change], DataFrame]:
    """What an ingest changes in ``documents`` and ``chunks``, and its report.

    Only new and changed documents are read again, chunked and embedded; of the others a narrow row is kept.
    ``chunks_of`` gives the stored chunks of some ``source_id``; it is asked only for documents whose link
    moved. With ``partial`` the files are not the whole corpus (a stream of changes), so nothing is an orphan.
    """
    # One narrow row per file; it becomes the document's row if the file is new or changed.
    facts = list(dict.fromkeys([*_CLASSIFIED, "project_slug", *_names(DOCUMENTS)]))
    described = cut_lineage(describe(files, entities).select(*facts))
    seen = cut_lineage(op.classify_changes(described.select(*_CLASSIFIED), documents, force))
    ok = seen.where(~F.col("read_error") & ~F.col("filtered"))
    wanted = broadcast_if_small(ok.where(F.col("change").isin("new", "changed")).select("source_id"))
    due = described.join(wanted, "source_id", "left_semi")
    # Texts meet only the entities that they name.
    named = cut_lineage(entities.join(due.select(F.col("project_slug").alias("slug")).distinct(), "slug", "left_semi"))
    pieces = op.chunk_documents(describe(files.join(wanted, "source_id", "left_semi"), named))
    # Embedding is the dear step; its result feeds both tables and the report.
    fresh = cut_lineage(
        embed(pieces, "embed_text", provider).select(*_names(CHUNKS))
    )
    counts = fresh.groupBy("source_id").agg(F.count("*").alias("n_chunks"))
    # A document that yields no chunks keeps its stored row and chunks.
    written = due.join(counts, "source_id", "left_semi").select(*_names(DOCUMENTS))
    moved = cut_lineage(ok.where(F.col("change") == "relink").select("source_id", "project_id"))
    linked, linked_chunks = op.relink(documents.join(moved, "source_id", "left_semi"), chunks_of(moved.select("source_id")), moved)
    gone = documents.select("source_id").where(F.lit(False))
    if not partial:
        # An unreadable file keeps its stored document.
        gone = op.orphans(documents.select("source_id"), seen.where(~F.col("filtered")).select("source_id"))
    gone = cut_lineage(gone)
    return {
        "documents": Change(written.unionByName(linked.select(*_names(DOCUMENTS))), gone),
        "chunks": Change(fresh.unionByName(linked_chunks.select(*_names(CHUNKS))), gone),
    }, op.ingest_report(seen, counts, gone.agg(F.count("*").alias("docs_deleted")))


def plan_ingest(
    files: DataFrame, documents: DataFrame, chunks: DataFrame, entities: DataFrame,
    provider: Callable[[], Embedder] = HashingEmbedder, force: bool = False, partial: bool = False,
) -> dict[str, DataFrame]:
    """``documents`` and ``chunks`` after the ingest, and its ``report``."""
    chunks_of = lambda ids: chunks.join(ids, "source_id", "left_semi")
    changes, report = plan_changes(files, documents, entities, chunks_of, provider, force, partial)
    after = {}
    for name, table in (("documents", documents), ("chunks", chunks)):
        change = changes[name]
        touched = change.rows.select("source_id").unionByName(change.owners)
        after[name] = op.replace_chunks(table, change.rows, touched)
    return {**after, "report": report}


def _names(ddl: str) -> list[str]:
    return [field.split()[0] for field in ddl.split(", ")]


def stored(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, int]:
    """Current documents, chunks and version; empty tables before the first run."""
    version = tables.current_version(spark, root)
    if version == 0:
        return spark.createDataFrame([], DOCUMENTS), spark.createDataFrame([], CHUNKS), 0
    return bucketed.read(spark, root, "documents", version), bucketed.read(spark, root, "chunks", version), version


def run_ingest(
    files: DataFrame, entities: DataFrame, target: str, force: bool = False, dry_run: bool = False,
    partial: bool = False, provider: Callable[[], Embedder] = HashingEmbedder, buckets: int = bucketed.BUCKETS,
) -> DataFrame:
    """Runs the job against the bucketed store at ``target`` and returns the report.

    What is written follows what has changed: new rows of changed documents, the ids of removed ones, and the buckets
    whose changes have piled up. With ``partial`` only the buckets of the files' ids are opened. A new store gets
    ``buckets`` of them, which should be as many as a full read has tasks.
    A dry run classifies and reports, and writes nothing.
    """
    spark = files.sparkSession
    if dry_run:
        documents, _, _ = stored(spark, target)
        seen = classify(files, documents, entities, force)
        none = seen.select("source_id").where(F.lit(False)).withColumn("n_chunks", F.lit(0).cast("long"))
        deleted = spark.range(1).select(F.lit(0).cast("long").alias("docs_deleted"))
        return op.ingest_report(seen, none, deleted, dry_run=True)
    if tables.current_version(spark, target) == 0:
        bucketed.create(spark, target, {"documents": ("source_id", DOCUMENTS), "chunks": ("source_id", CHUNKS)}, buckets)

    def rows_of(name: str, ids: DataFrame) -> DataFrame:
        found = bucketed.read(spark, target, name, buckets=bucketed.buckets_of(spark, target, name, ids))
        return found.join(ids, "source_id", "left_semi")

    documents = rows_of("documents", files.select("source_id")) if partial else bucketed.read(spark, target, "documents")
    changes, report = plan_changes(
        files, documents, entities, lambda ids: rows_of("chunks", ids), provider, force, partial
    )
    report = cut_lineage(report)
    bucketed.commit(spark, target, changes)
    return report
