"""Streaming operators, sources, and evaluation over the given tables."""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from driver_queries import dialogues as dg
from driver_queries.corpus import STREAMED_SQL, entities as corpus_entities, files as corpus_files
from driver_queries.registry import Registry
from driver_queries.retrieval import HYBRID_SQL, general_evidence
from driver_queries.tables import load
from evidentia.operators import evaluation, validation
from evidentia.operators.ingest import upsert
from evidentia.plans.ingest import stored
from evidentia.operators.substring_join import substring_join
from evidentia.session import prepare
from evidentia.sources import bucketed, markdown, tables
from evidentia.sources.bucketed import Change
from evidentia.streaming import limiter, memory, runs
from evidentia.streaming.tables import (
    compact, compact_rollup, read_latest, read_rollup, stream_dedupe as dedupe, stream_ingest as ingest, stream_rollup as rollup, stream_upsert,
)

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


def table_stream(spark, sf_dir, name):
    """A given table, one file or a folder of files, as a file stream."""
    schema = load(spark, sf_dir, name).schema
    stored_schema = prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet").schema
    # A stream takes a plain path for a folder; a pattern may stand for either.
    stream = spark.readStream.schema(stored_schema).option("maxBytesPerTrigger", 4 << 30).parquet(f"{sf_dir}/{name}.parque[t]")
    return stream.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


@query(dg._log_sql(2, 43200) + " SELECT event_id AS request_id, accepted FROM log")
def stream_limit(spark, sf_dir):
    requests = table_stream(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_id"), F.lit("chat").alias("namespace"),
        F.col("user_id").cast("string").alias("client"), "ts", F.lit(2).alias("minute_limit"),
    )
    return runs.drain(limiter.stream_limit(requests, 43200), "limit").select("request_id", "accepted")


def message_stream(spark, sf_dir):
    turn, conv = F.col("turn"), F.col("conv_id")
    return table_stream(spark, sf_dir, "conversations").select(
        (conv * 1000 + turn).alias("message_id"), conv.alias("conversation_id"), (turn + 1).cast("int").alias("sequence_no"),
        "role", F.col("text").alias("content"), F.when(turn % 7 == 6, "failed").otherwise("completed").alias("status"),
        F.when(F.col("role") == "user", conv * 1000 + F.floor(turn / 4)).alias("client_message_id"),
        F.timestamp_seconds(F.lit(1704067200) + conv * 3600 + turn * 97).alias("created_at"),
    )


@query(
    dg.W + ", n AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY sequence_no DESC) AS rn FROM msgs WHERE status = 'completed'),"
    f" s AS (SELECT conversation_id, string_agg({dg._LINE}, chr(10) ORDER BY sequence_no) AS t, max(sequence_no) AS top FROM (SELECT *, {dg._FLAT} AS flat FROM n WHERE rn > 2) GROUP BY 1),"
    " k AS (SELECT conversation_id, string_agg(sequence_no, ',' ORDER BY sequence_no) AS recent FROM n WHERE rn <= 2 GROUP BY 1)"
    " SELECT conversation_id, coalesce(t, '') AS summary, coalesce(top, 0) AS summarized_through_sequence, recent FROM k LEFT JOIN s USING (conversation_id)"
)
def stream_memory(spark, sf_dir):
    """Limits that clip nothing, so the stream equals one batch step from an empty state."""
    rolled = memory.stream_memory(message_stream(spark, sf_dir), n=2, budget=1_000_000, max_chars=1_000_000)
    return runs.drain(rolled, "memory").select(
        "conversation_id", "summary", "summarized_through_sequence",
        F.array_join(F.col("recent_sequences").cast("array<string>"), ",").alias("recent"),
    )


@query(
    dg.W + " SELECT conversation_id, client_message_id, count(*) AS n FROM (SELECT DISTINCT conversation_id, client_message_id FROM msgs WHERE client_message_id IS NOT NULL) GROUP BY 1, 2"
    " UNION ALL SELECT conversation_id, -1, count(*) FROM msgs WHERE client_message_id IS NULL GROUP BY 1"
)
def stream_dedupe(spark, sf_dir):
    kept = runs.drain(dedupe(message_stream(spark, sf_dir), "365 days"), "dedupe")
    return kept.groupBy("conversation_id", F.coalesce("client_message_id", F.lit(-1)).alias("client_message_id")).agg(
        F.count("*").alias("n")
    )


@query(
    dg.W + " SELECT message_id, arg_max(rating, (ts, feedback_id)) AS rating, max(feedback_id) AS n FROM fb WHERE message_id IS NOT NULL GROUP BY 1"
)
def stream_feedback(spark, sf_dir):
    kind = F.col("event_type")
    given = table_stream(spark, sf_dir, "events").where(kind != "view").select(
        ((F.col("event_id") % 100) * 1000 + F.col("user_id") % 5).alias("message_id"),
        F.col("event_id").alias("feedback_id"),
        F.when(kind == "error", -1).when(kind == "signup", 0).otherwise(1).cast("int").alias("rating"),
        F.col("ts").alias("created_at"),
    )
    root = runs.new_folder(spark, "feedback")
    keys, order = ["message_id"], ["created_at", "feedback_id"]
    stream_upsert(given, f"{root}/table", keys, order, f"{root}/checkpoint").awaitTermination()
    compact(spark, f"{root}/table", keys, order)
    return read_latest(spark, f"{root}/table", keys, order).select("message_id", "rating", F.col("feedback_id").alias("n"))


@query(dg.ROLLUP_SQL)
def stream_rollup(spark, sf_dir):
    """Messages as a stream into facts per conversation, folded, against the batch rollup's oracle."""
    root = runs.new_folder(spark, "rollup")
    rollup(message_stream(spark, sf_dir), f"{root}/table", f"{root}/checkpoint").awaitTermination()
    compact_rollup(spark, f"{root}/table")
    return read_rollup(spark, f"{root}/table", dg.conversations(spark, sf_dir)).select(
        "conversation_id", "message_count", dg.SECONDS(F.col("last_message_at")).alias("last_s"),
        F.coalesce("title", F.lit("")).alias("title"),
    )


@query(
    "SELECT 2 AS version, doc_id, n_chars FROM documents UNION ALL"
    " SELECT 3, doc_id, CASE WHEN doc_id % 7 = 0 THEN n_chars + 1 ELSE n_chars END FROM documents WHERE doc_id % 7 = 0 OR doc_id % 11 <> 0"
)
def store_versions(spark, sf_dir):
    """All documents as one version of a bucketed store, replaced and removed ones as the next; both are read back."""
    root = runs.new_folder(spark, "store")
    documents = load(spark, sf_dir, "documents").select("doc_id", "n_chars")
    bucketed.create(spark, root, {"documents": ("doc_id", documents.schema)}, buckets=8)
    bucketed.commit(spark, root, {"documents": Change(documents)})
    changed = documents.where("doc_id % 7 = 0").withColumn("n_chars", (F.col("n_chars") + 1).cast(documents.schema["n_chars"].dataType))
    removed = documents.where("doc_id % 11 = 0 and doc_id % 7 <> 0").select("doc_id")
    bucketed.commit(spark, root, {"documents": Change(changed, removed)})
    versions = [bucketed.read(spark, root, "documents", v).withColumn("version", F.lit(v)) for v in (2, 3)]
    return versions[0].unionByName(versions[1])


@query(
    "WITH g AS (SELECT event_id AS generation_id, epoch_ms(date_trunc('milliseconds', ts)) AS started_ms, event_id % 3 AS kind FROM events),"
    " m AS (SELECT greatest(max(started_ms), max(CASE WHEN kind = 0 THEN started_ms + 60000 WHEN kind = 1 THEN started_ms + 200000 END)) AS top FROM g)"
    " SELECT generation_id, started_ms FROM g, m WHERE kind <> 0 AND started_ms + 120000 <= top"
)
def stream_stale(spark, sf_dir):
    """Each event starts an answer; a third end after one minute, a third after 200 seconds, a third never."""
    n = F.col("event_id")
    end = F.when(n % 3 == 0, F.lit(60)).when(n % 3 == 1, F.lit(200))
    shifted = F.timestamp_millis(F.unix_millis("ts") + F.coalesce(end, F.lit(0)) * 1000)
    phases = F.array_compact(
        F.array(
            F.struct(F.lit("started").alias("phase"), F.col("ts").alias("ts")),
            F.when(end.isNotNull(), F.struct(F.lit("finished").alias("phase"), shifted.alias("ts"))),
        )
    )
    generations = table_stream(spark, sf_dir, "events").select(n.alias("generation_id"), F.explode(phases).alias("p")).select(
        "generation_id", "p.phase", "p.ts"
    )
    return runs.drain(memory.stream_stale(generations), "stale")


@query(STREAMED_SQL)
def stream_ingest(spark, sf_dir):
    """The files of the corpus as a stream into a bucketed store; counts per document type."""
    root = runs.new_folder(spark, "ingest")
    corpus_files(spark, sf_dir).write.parquet(f"{root}/in")
    arriving = spark.readStream.schema("source_id string, text string").parquet(f"{root}/in")
    ingest(arriving, corpus_entities(spark, sf_dir), f"{root}/snapshot", f"{root}/checkpoint", buckets=8).awaitTermination()
    documents, chunks, _ = stored(spark, f"{root}/snapshot")
    return (
        chunks.groupBy("source_id").agg(F.count("*").alias("n_chunks"))
        .join(documents.select("source_id", "document_type"), "source_id")
        .groupBy("document_type").agg(F.count("*").alias("documents"), F.sum("n_chunks").alias("chunks"))
    )


# --- sources -------------------------------------------------------------------------


def _write_one_each(lines, folder):
    """Every row as a file of its own, ended by a line break; the tasks write them, in a folder per partition.

    Hadoop's local file system starts a process for the mode of each new file, and the writer's commit moves the files
    one by one; on such a system the tasks open the files themselves. A repeated task writes the same names again.
    """
    spark = lines.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme() != "file":
        lines.write.option("maxRecordsPerFile", 1).text(folder)
        return
    local = path.toUri().getPath()

    def write(batches):
        task, n = TaskContext.get(), 0
        part = f"{local}/{task.partitionId():05d}"
        os.makedirs(part, exist_ok=True)
        for batch in batches:
            for value in batch.column(0):
                name = f"{part}/{n:09d}"
                with open(f"{name}.{task.taskAttemptId()}", "wb") as file:
                    file.write((value.as_py() or b"") + b"\n")
                os.replace(f"{name}.{task.taskAttemptId()}", f"{name}.txt")
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], type=pa.int64())], names=["n"])

    os.makedirs(local, exist_ok=True)
    lines.select(F.col("value").cast("binary")).mapInArrow(write, "n long").agg(F.sum("n")).collect()


@query("SELECT count(*) AS files, sum(strlen(text) + 1) AS bytes, 0 AS errors FROM documents")
def markdown_scan(spark, sf_dir):
    """Every document written as a file of its own (the writer ends it with a line break), then scanned."""
    root = runs.new_folder(spark, "markdown")
    documents = load(spark, sf_dir, "documents").select(F.col("text").alias("value"))
    _write_one_each(documents, f"{root}/docs")
    scanned = markdown.read_markdown(spark, f"{root}/docs", "*.txt")
    return scanned.agg(
        F.count("*").alias("files"), F.sum(F.octet_length("text")).alias("bytes"),
        F.count_if("read_error").alias("errors"),
    )


def golden(spark, sf_dir):
    """Benchmark passages; expected are the documents that quote them."""
    cases = load(spark, sf_dir, "benchmark").select(
        F.col("item_id").cast("string").alias("id"), F.lit("quote").alias("category"), F.col("text").alias("question")
    )
    documents = load(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc"), "text")
    quoted = substring_join(documents, "text", cases.select("id", "question"), "question", key="doc")
    found = quoted.groupBy("id").agg(F.array_sort(F.collect_set("doc")).alias("expected_sources"))
    none = F.array().cast("array<string>")
    return cases.join(found, "id", "left").withColumn("expected_sources", F.coalesce("expected_sources", none))


_GOLDEN = (
    "golden AS (SELECT CAST(item_id AS VARCHAR) AS id, b.text AS question, list_sort(list(CAST(doc_id AS VARCHAR)) FILTER (doc_id IS NOT NULL)) AS expected"
    " FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY 1, 2)"
)


@query(f"WITH {_GOLDEN} SELECT id, question, coalesce(array_to_string(expected, ','), '') AS expected FROM golden")
def golden_source(spark, sf_dir):
    root = runs.new_folder(spark, "golden")
    # One JSON array per file, fifty cases each.
    array = F.to_json(F.collect_list(F.struct("id", "category", "question", "expected_sources")))
    arrays = golden(spark, sf_dir).groupBy(F.floor(F.col("id").cast("long") / 50).alias("part")).agg(array.alias("value"))
    arrays.write.partitionBy("part").text(f"{root}/cases")
    return tables.read_golden(spark, f"{root}/cases").select(
        "id", "question", F.coalesce(F.array_join("expected_sources", ","), F.lit("")).alias("expected")
    )


@query(f"WITH {_GOLDEN} SELECT id, 'no_source' AS rule FROM golden WHERE coalesce(len(expected), 0) = 0")
def check_golden(spark, sf_dir):
    return validation.check_golden(golden(spark, sf_dir))


def cases(spark, sf_dir):
    evidence, _ = general_evidence(spark, sf_dir, min_score=0.0, top_k=5)
    found = evidence.select(
        F.col("question_id").cast("string").alias("id"), "rank", F.col("chunk_id").cast("string").alias("source_id")
    )
    latency = load(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("id"), F.col("value").alias("latency_ms"))
    return evaluation.hit_at_k(golden(spark, sf_dir), found).join(latency, "id", "left")


_CASES = (
    HYBRID_SQL.format(min_score=0.0).replace("vrank <= 20", "vrank <= 10").replace("lrank <= 20", "lrank <= 10") + f", {_GOLDEN},"
    " found AS (SELECT CAST(question_id AS VARCHAR) AS id, list(CAST(chunk_id AS VARCHAR) ORDER BY rank) AS got FROM evidence GROUP BY 1),"
    " cases AS (SELECT id, coalesce(got, []) AS got, list_sort(list_intersect(coalesce(expected, []), coalesce(got, []))) AS matched, value AS latency_ms"
    " FROM golden LEFT JOIN found USING (id) LEFT JOIN events ON id = CAST(event_id AS VARCHAR))"
)


@query(
    _CASES + " SELECT id, array_to_string(got, ',') AS retrieved, array_to_string(matched, ',') AS matched, CASE WHEN len(matched) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS hit FROM cases"
)
def hit_at_k(spark, sf_dir):
    return cases(spark, sf_dir).select(
        "id", F.array_join("retrieved_sources", ",").alias("retrieved"), F.array_join("matched_sources", ",").alias("matched"), "hit"
    )


@query(
    _CASES + " SELECT count(*) AS sample_size, round(avg(CASE WHEN len(matched) > 0 THEN 1.0 ELSE 0.0 END), 4)::DOUBLE AS hit_rate, round(avg(latency_ms), 1) AS mean_latency_ms,"
    " quantile_disc(latency_ms, 0.95) AS p95_latency_ms FROM cases"
)
def evaluation_summary(spark, sf_dir):
    return evaluation.evaluation_summary(cases(spark, sf_dir))


@query(
    _CASES + " SELECT id, array_to_string(got, ',') AS retrieved, array_to_string(matched, ',') AS matched,"
    " CASE WHEN len(matched) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS score, -1 AS sample_size FROM cases"
    " UNION ALL SELECT 'summary', '', '', round(avg(CASE WHEN len(matched) > 0 THEN 1.0 ELSE 0.0 END), 4)::DOUBLE, count(*) FROM cases"
)
def evaluation_artifact(spark, sf_dir):
    """The artifact written as JSON lines, read back and parsed: the summary and every case."""
    root = runs.new_folder(spark, "evaluation")
    result = evaluation.evaluation_result(cases(spark, sf_dir), "benchmark", "2024-01-01T00:00:00Z")
    tables.write_evaluation(result, f"{root}/latest")
    body = "id string, hit_at_5 double, retrieved_sources array<string>, matched_sources array<string>, sample_size int, metrics struct<hit_rate_at_5: double>"
    line = spark.read.text(f"{root}/latest").select(F.from_json("value", body).alias("l"))
    listed = lambda c: F.coalesce(F.array_join(c, ","), F.lit(""))
    return line.select(
        F.coalesce("l.id", F.lit("summary")).alias("id"), listed("l.retrieved_sources").alias("retrieved"),
        listed("l.matched_sources").alias("matched"), F.coalesce("l.hit_at_5", "l.metrics.hit_rate_at_5").alias("score"),
        F.coalesce("l.sample_size", F.lit(-1)).alias("sample_size"),
    )


def catalogue_rows(spark, sf_dir, name):
    n = F.col("p_partkey")
    links = F.array(
        F.struct(F.lit("home").alias("label"), F.concat(F.lit(" https://example.com/"), n.cast("string")).alias("url")),
        F.struct(F.lit("bad").alias("label"), F.lit("javascript:x").alias("url")),
    )
    return load(spark, sf_dir, "part").select(
        F.concat(F.lit("p"), n.cast("string")).alias("slug"), F.concat(F.lit(name), "p_name").alias("title"),
        F.concat(F.lit("<p>"), "p_name", F.lit("</p><script>x</script>")).alias("content_html"), links.alias("related_links"),
    )


@query(
    "SELECT 'p' || p_partkey AS slug, CASE WHEN p_size > 25 THEN 'new ' ELSE 'old ' END || p_name AS title,"
    " CASE WHEN p_size > 25 THEN '<p>' || p_name || '</p>x' ELSE '<p>' || p_name || '</p><script>x</script>' END AS content_html,"
    " CASE WHEN p_size > 25 THEN 'https://example.com/' || p_partkey ELSE ' https://example.com/' || p_partkey || '|javascript:x' END AS urls FROM part"
)
def load_catalogue(spark, sf_dir):
    """Stored rows for all parts; large parts arrive again under a new title."""
    large = load(spark, sf_dir, "part").where(F.col("p_size") > 25).select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("slug")
    )
    incoming = catalogue_rows(spark, sf_dir, "new ").join(large, "slug", "left_semi")
    merged = tables.load_catalogue(catalogue_rows(spark, sf_dir, "old "), incoming)
    return merged.select("slug", "title", "content_html", F.array_join(F.transform("related_links", lambda l: l["url"]), "|").alias("urls"))


@query("SELECT doc_id, md5(CASE WHEN doc_id % 2 = 0 THEN text || '!' ELSE text END) AS text_md5 FROM documents")
def snapshot_versions(spark, sf_dir):
    """Two versions of a table; the second replaces every other row."""
    root = runs.new_folder(spark, "snapshot")
    first = load(spark, sf_dir, "documents").select("doc_id", "text")
    tables.save_snapshot(spark, root, {"documents": first}, 1)
    stored_rows = tables.load_snapshot(spark, root, "documents")
    changed = stored_rows.where(F.col("doc_id") % 2 == 0).withColumn("text", F.concat("text", F.lit("!")))
    tables.save_snapshot(spark, root, {"documents": upsert(stored_rows, changed, "doc_id")}, 2)
    return tables.load_snapshot(spark, root, "documents").select("doc_id", F.md5("text").alias("text_md5"))
