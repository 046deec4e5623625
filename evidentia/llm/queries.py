"""One query per operator, over the whole tables, with its DuckDB oracle where SQL can say it."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from evidentia.llm import (
    histogram_packing, language_id, line_dedup, lm_scores, near_dup, packing, phrase_index, prefix_trie, secrets, shards,
    vector_links, warc, whitening,
)
from evidentia.llm.common import fold, map_batches, prepare

QUERIES: dict = {}
ORACLES: dict = {}


def query(oracle: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLES[fn.__name__] = oracle
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op2_stratified_interleaving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards of all documents, each with the mixture of sources."""
    return shards.interleave(table(spark, sf_dir, "documents"), n_shards=8).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "source",
    )


@query(
    """
WITH lines AS (
  SELECT doc_id, generate_subscripts(l, 1) AS n, unnest(l) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), shared AS (
  SELECT k, min(doc_id) AS first_doc FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1
), marked AS (
  SELECT doc_id, n, line, s.k IS NOT NULL AND doc_id <> first_doc AS dropped FROM keyed LEFT JOIN shared s USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""
)
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines repeated across documents, dropped everywhere but in the smallest id."""
    docs = line_dedup.keyed(table(spark, sf_dir, "documents"))

    def digest(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        cuts = [line_dedup.cut(t.as_py(), b.as_py()) for t, b in zip(batch.column("text"), batch.column("bitmap"))]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), pa.array([c[1] for c in cuts], type=pa.int64()),
                pa.array([c[2] for c in cuts], type=pa.int64()),
                pa.array([hashlib.sha256(c[0].encode()).hexdigest() for c in cuts], type=pa.string()),
            ],
            names=["doc_id", "n_lines", "n_dropped", "kept_sha256"],
        )

    rows = line_dedup.with_bitmaps(docs, line_dedup.line_bitmaps(docs)).select("doc_id", "text", "bitmap")
    return map_batches(rows, digest, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


_WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


@query(
    f"""
WITH words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}'), []) AS w
  FROM documents
), items AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w
  FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, array_to_string(w[p:p + 9], ' ') AS k, least(10, len(w)) AS n
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS p FROM items WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM windows
), grams AS (
  SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS p FROM words, sizes WHERE len(w) >= n)
), found AS (SELECT doc_id, p, n, item_id FROM grams JOIN windows USING (k, n)
), hits AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(generate_series(p, p + n - 1)) AS pos FROM found) GROUP BY doc_id
), owners AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hits USING (doc_id) LEFT JOIN owners USING (doc_id)"""
)
def op1_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows found word for word in all documents."""
    index = phrase_index.build_index(table(spark, sf_dir, "documents"))
    found = phrase_index.find_items(index, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


@query()
def op8_fast_similarity_sketching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near-duplicate documents on four-word shingles."""
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), size=4)


@query()
def op9_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query(
    """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT html, max(page_id) AS holder FROM p WHERE strlen(html) >= 1000 GROUP BY html)
SELECT page_id, strlen(p.html) AS payload_bytes, sha1(p.html) AS payload_digest,
       CASE WHEN holder <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN holder <> page_id THEN holder END AS refers_to
FROM p LEFT JOIN h ON h.html = p.html"""
)
def op10_zstd_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives with revisit records, and what reading them back gives."""
    read = warc.round_trip(table(spark, sf_dir, "pages"))
    checked = F.when(F.col("error").isNotNull(), F.raise_error(F.col("error")).cast("long")).otherwise(F.col("page_id"))
    return read.select(checked.alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


@query()
def op3_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from three folds out of four."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", fold(4) == 2)
    model = language_id.learn(docs.filter("not held_out"))
    found = language_id.predict(docs.select("doc_id", "held_out", "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"), "phrase_length")


@query()
def op6_epsilon_grid_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors linked by a cosine of 0.9 or more, and their components."""
    return vector_links.vector_links(table(spark, sf_dir, "embeddings"), least=0.9)


@query()
def op7_randomness_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents: fixed patterns, and strings that pass as random."""
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    counts = [secrets.count_of("base", kind).alias(f"n_{kind}") for kind in secrets.KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(secrets.listed("base"), 256).alias("base_sha256"), secrets.listed("spans").alias("spans"))


@query()
def op4_attention_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probabilities of all documents, learned from six folds out of seven."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held", fold(7) == 2)
    return lm_scores.score_texts(docs, public_tokenizers.path("word_bpe_49k.json"), held_out="held")


@query()
def op11_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens by repeat counts fitted to the histogram of lengths."""
    return histogram_packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query()
def op13_qdwh_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All usable vectors on up to 16 whitened components."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=16)


_HEADS = """
list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: ascii(ch)::BIGINT)),
  lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
    lambda bits, _: xor(bits >> 1, 3988292384 * (bits & 1))))"""


@query(
    f"""
WITH own AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos, md5(coalesce(role, '') || chr(0) || coalesce(text, '')) AS k,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, n, xor({_HEADS}, 4294967295) % 4 AS h, conv_id - conv_id % 20 AS base
  FROM (SELECT conv_id, count(*) AS n FROM own GROUP BY conv_id)
), sized AS (
  SELECT c.*, least(h, coalesce(b.n, 0)) AS lent FROM convs c LEFT JOIN (SELECT conv_id AS base, n FROM convs) b USING (base)
), turns AS (
  SELECT c.conv_id, pos, k, words FROM sized c JOIN own o ON o.conv_id = c.base AND pos <= h
  UNION ALL SELECT c.conv_id, lent + pos - h, k, words FROM sized c JOIN own o ON o.conv_id = c.conv_id AND pos > h
), paths AS (
  SELECT conv_id, pos AS depth, words, md5(string_agg(k, ',') OVER (PARTITION BY conv_id ORDER BY pos)) AS node FROM turns
  UNION ALL SELECT conv_id, 0, 0, '' FROM convs
), nodes AS (
  SELECT node, min(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(words) AS saved,
         min(parent) AS parent, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE last), '') AS ends
  FROM (SELECT *, lag(node) OVER w AS parent, lead(node) OVER w IS NULL AS last FROM paths WINDOW w AS (PARTITION BY conv_id ORDER BY depth))
  GROUP BY node
), children AS (SELECT parent AS node, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent
), sums AS (
  SELECT top AS node, sum(saved) AS saved_tokens, count(*) FILTER (WHERE n_children IS NULL) AS n_leaves
  FROM (SELECT DISTINCT a.node AS top, b.node FROM paths a JOIN paths b ON a.conv_id = b.conv_id AND a.depth <= b.depth)
  JOIN nodes USING (node) LEFT JOIN children USING (node) GROUP BY top
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM nodes n JOIN sums USING (node) LEFT JOIN children USING (node) LEFT JOIN nodes p ON p.node = n.parent"""
)
def op12_centroid_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations with shared heads, every node with the totals of its subtree."""
    convs, turns = prefix_trie.with_shared_heads(prefix_trie.numbered_turns(table(spark, sf_dir, "conversations")))
    return prefix_trie.prefix_trie(turns, convs)
