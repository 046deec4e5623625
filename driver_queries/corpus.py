"""Ingest and validation over Markdown files built from the documents table."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from driver_queries.registry import Registry
from driver_queries.tables import load
from evidentia.functions import markdown as md
from evidentia.operators import ingest as op, validation
from evidentia.operators.embedding import embed
from evidentia.plans import ingest as job
from evidentia.streaming import runs

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


def files(spark, sf_dir, edition=1):
    """One Markdown file per document: a header (with planted faults) and headed sections.

    The second edition changes some texts, drops some files and adds a slug to some.
    """
    n = F.col("doc_id")
    rows = F.transform(
        F.split("text", "\n"),
        lambda line, i: F.concat(
            F.when((i % 12 == 0) & (n % 5 != 0), F.concat(F.lit("## Part "), (i / 12).cast("int").cast("string"), F.lit("\n\n"))).otherwise(""),
            line,
            F.when(i % 3 == 2, "\n\n").otherwise("\n"),
        ),
    )
    opt = lambda cond, *parts: F.when(cond, F.concat(*parts)).otherwise("")
    pick = lambda *values: F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))
    header = F.concat(
        opt(n % 10 != 4, F.lit("id: d"), F.when(n % 10 == 3, n - 1).otherwise(n).cast("string"), F.lit("\n")),
        F.lit("title: 'About: "), "source", F.lit("'\n"),
        F.lit("type: "), pick("profile", "project", "skill", "weird"), F.lit("\n"),
        F.when(n % 9 == 0, "visibility: private\n").when(n % 9 == 1, "visibility: hidden\n").when(n % 9 == 2, "").otherwise("visibility: public\n"),
        F.lit("confidence: "), pick("confirmed", "self_reported", "unverified", "guess"), F.lit("\n"),
        F.when(n % 2 == 0, F.concat(F.lit("tags:\n- "), "lang", F.lit("\n  - "), "source", F.lit("\n")))
        .otherwise(F.concat(F.lit("tags: ["), "lang", F.lit(", x]\n"))),
        opt(n % 3 == 0, F.lit("section: main\n")),
        opt(n % 6 == (0 if edition == 1 else 1), F.lit("project_slug: "), "source", F.lit("\n")),
    )
    body = F.array_join(rows, "")
    if edition == 2:
        body = F.when(n % 4 == 1, F.concat(body, F.lit("\nchanged\n"))).otherwise(body)
    text = (
        F.when(n % 10 == 7, body)
        .when(n % 10 == 8, F.concat(F.lit("---\n"), header, F.lit("\n"), body))
        .otherwise(F.concat(F.lit("---\n"), header, F.lit("---\n"), body))
    )
    path = F.concat(
        F.lit("knowledge/"), pick("projects", "profile", "data", "notes", "projects"), F.lit("/doc"),
        n.cast("string"), F.when(n % 2 == 0, "ReadMe").otherwise(""), F.lit(".md"),
    )
    out = load(spark, sf_dir, "documents").select("doc_id", path.alias("source_id"), text.alias("text"))
    if edition == 2:
        out = out.where(n % 17 != 5)
    return out.drop("doc_id")


def _files_sql(edition=1):
    changed = "CASE WHEN n % 4 = 1 THEN body || chr(10) || 'changed' || chr(10) ELSE body END" if edition == 2 else "body"
    slug = 0 if edition == 1 else 1
    keep = " WHERE n % 17 <> 5" if edition == 2 else ""
    return f"""
files{edition} AS (
  SELECT 'knowledge/' || (['projects', 'profile', 'data', 'notes', 'projects'])[n % 5 + 1] || '/doc' || n
           || CASE WHEN n % 2 = 0 THEN 'ReadMe' ELSE '' END || '.md' AS source_id,
         CASE WHEN n % 10 = 7 THEN b WHEN n % 10 = 8 THEN '---' || chr(10) || header || chr(10) || b
              ELSE '---' || chr(10) || header || '---' || chr(10) || b END AS text
  FROM (SELECT *, {changed} AS b FROM (
    SELECT doc_id AS n,
      CASE WHEN n % 10 <> 4 THEN 'id: d' || CASE WHEN n % 10 = 3 THEN n - 1 ELSE n END || chr(10) ELSE '' END
      || 'title: ''About: ' || source || '''' || chr(10)
      || 'type: ' || (['profile', 'project', 'skill', 'weird'])[n % 4 + 1] || chr(10)
      || CASE n % 9 WHEN 0 THEN 'visibility: private' || chr(10) WHEN 1 THEN 'visibility: hidden' || chr(10)
                    WHEN 2 THEN '' ELSE 'visibility: public' || chr(10) END
      || 'confidence: ' || (['confirmed', 'self_reported', 'unverified', 'guess'])[n % 4 + 1] || chr(10)
      || CASE WHEN n % 2 = 0 THEN 'tags:' || chr(10) || '- ' || lang || chr(10) || '  - ' || source || chr(10)
              ELSE 'tags: [' || lang || ', x]' || chr(10) END
      || CASE WHEN n % 3 = 0 THEN 'section: main' || chr(10) ELSE '' END
      || CASE WHEN n % 6 = {slug} THEN 'project_slug: ' || source || chr(10) ELSE '' END AS header,
      array_to_string(list_transform(string_split(text, chr(10)), lambda l, i:
        CASE WHEN (i - 1) % 12 = 0 AND n % 5 <> 0 THEN '## Part ' || ((i - 1) // 12) || chr(10) || chr(10) ELSE '' END
        || l || CASE WHEN (i - 1) % 3 = 2 THEN chr(10) || chr(10) ELSE chr(10) END), '') AS body
    FROM documents)){keep}
)"""


_KEY = "regexp_extract(header, '(?m)^{0}: (.*)$', 1)"


def _parsed_sql(edition=1):
    key = lambda name: _KEY.format(name)
    return f"""
split{edition} AS (
  SELECT source_id, text, closed,
         CASE WHEN closed THEN regexp_replace(substr(text, 4, e - 4), '^\\s+|\\s+$', '', 'g') ELSE '' END AS header,
         CASE WHEN closed THEN regexp_replace(substr(text, e + 4), '^\\s+|\\s+$', '', 'g') ELSE text END AS body
  FROM (SELECT *, brk + 3 AS e, starts_with(text, '---') AND brk > 0 AS closed
        FROM (SELECT *, instr(substr(text, 4), chr(10) || '---') AS brk FROM files{edition}))
),
meta{edition} AS (
  SELECT source_id, text, closed, header, body, nullif({key('id')}, '') AS id,
         nullif(trim({key('title')}, ''''), '') AS title, nullif({key('type')}, '') AS type,
         nullif({key('visibility')}, '') AS visibility, nullif({key('confidence')}, '') AS confidence,
         {key('section')} AS section, nullif({key('project_slug')}, '') AS slug,
         CASE WHEN {key('tags')} <> '' THEN [{key('tags')}]
              ELSE list_transform(regexp_extract_all(header, '(?m)^ *- .*$'), lambda t: trim(t, ' -')) END AS embed_tags,
         CASE WHEN {key('tags')} <> '' THEN [] ELSE list_transform(regexp_extract_all(header, '(?m)^ *- .*$'), lambda t: trim(t, ' -')) END AS tags,
         regexp_extract(source_id, '([^/]*)\\.md$', 1) AS stem, string_split(source_id, '/') AS parts
  FROM split{edition}
)"""


def _with(edition=1):
    return "WITH " + _files_sql(edition) + "," + _parsed_sql(edition)


def _described(spark, sf_dir, edition=1):
    return op.default_meta(op.parse_files(files(spark, sf_dir, edition)))


@query(
    _with() + " SELECT source_id, coalesce(id, '') AS id, coalesce(title, '') AS title, coalesce(type, '') AS type,"
    " coalesce(visibility, '') AS visibility, section, coalesce(slug, '') AS project_slug,"
    " array_to_string(embed_tags, '|') AS tags, md5(body) AS body_md5 FROM meta1"
)
def front_matter(spark, sf_dir):
    meta = F.col("meta")
    value = lambda k: F.coalesce(md.meta_value(meta, k), F.lit(""))
    tags = md.meta_entry(meta, "tags")["values"]
    return op.parse_files(files(spark, sf_dir)).select(
        "source_id",
        *[value(k).alias(k) for k in ("id", "title", "type", "visibility", "section", "project_slug")],
        F.coalesce(F.array_join(tags, "|"), F.lit("")).alias("tags"),
        F.md5("body").alias("body_md5"),
    )


@query(
    _with() + " SELECT source_id, k AS key FROM (SELECT source_id, unnest(list_distinct("
    "regexp_extract_all(header, '(?m)^([a-z_]+):', 1))) AS k FROM meta1)"
)
def front_matter_keys(spark, sf_dir):
    """Header as a map."""
    return op.parse_files(files(spark, sf_dir)).select(
        "source_id", F.explode(F.map_keys(md.meta_map(F.col("meta")))).alias("key")
    )


@query(
    _with() + " SELECT source_id, coalesce(id, stem) AS doc_key, coalesce(title, stem) AS title,"
    " coalesce(type, 'profile') AS document_type, coalesce(visibility, 'public') AS visibility,"
    " coalesce(confidence, 'self_reported') AS confidence, array_to_string(tags, '|') AS tags FROM meta1"
)
def default_meta(spark, sf_dir):
    return _described(spark, sf_dir).select(
        "source_id", "doc_key", "title", "document_type", "visibility", "confidence",
        F.array_join("tags", "|").alias("tags"),
    )


_FILTERED = "(parts[2] IN ('data', 'prompts', 'sources') OR coalesce(visibility, '') = 'private')"


@query(_with() + f" SELECT source_id FROM meta1 WHERE NOT {_FILTERED}")
def source_filter(spark, sf_dir):
    return op.filter_sources(op.parse_files(files(spark, sf_dir))).select("source_id")


_SLUG = (
    "CASE WHEN slug IS NOT NULL THEN slug WHEN parts[2] = 'projects' THEN regexp_replace(stem, '(?i)readme$', '') END"
)


@query(_with() + f" SELECT source_id, coalesce({_SLUG}, '') AS project_slug FROM meta1")
def infer_slug(spark, sf_dir):
    return op.infer_slug(op.parse_files(files(spark, sf_dir))).select(
        "source_id", F.coalesce("project_slug", F.lit("")).alias("project_slug")
    )


@query(_with() + " SELECT source_id, sha256(text) AS content_hash FROM files1")
def content_hash(spark, sf_dir):
    return files(spark, sf_dir).select("source_id", op.content_hash(F.col("text")).alias("content_hash"))


def entities(spark, sf_dir, shift=0):
    """part rows as entities: slug doc<even number>."""
    return load(spark, sf_dir, "part").select(
        (F.col("p_partkey") + shift).alias("entity_id"),
        F.concat(F.lit("doc"), (F.col("p_partkey") * 2).cast("string")).alias("slug"),
        F.col("p_name").alias("title"),
    )


_ENTITIES = "entities AS (SELECT p_partkey AS entity_id, 'doc' || (p_partkey * 2) AS slug FROM part)"


@query(
    _with() + f", {_ENTITIES} SELECT source_id, coalesce(entity_id, -1) AS project_id,"
    f" (s IS NOT NULL AND entity_id IS NULL) AS unmatched FROM (SELECT source_id, {_SLUG} AS s FROM meta1) m"
    " LEFT JOIN entities e ON e.slug = m.s"
)
def link_entities(spark, sf_dir):
    described = op.infer_slug(op.parse_files(files(spark, sf_dir)))
    return op.link_entities(described, entities(spark, sf_dir)).select(
        "source_id", F.coalesce("project_id", F.lit(-1)).alias("project_id"),
        F.col("unmatched_slug").alias("unmatched"),
    )


def _stored(spark, sf_dir):
    """The first edition as it was stored; some links differ from today's."""
    linked = op.link_entities(
        op.infer_slug(_described(spark, sf_dir)).withColumn("content_hash", op.content_hash(F.col("text"))),
        entities(spark, sf_dir),
    ).where(~op.is_filtered())
    moved = F.when(F.col("project_id") % 3 == 0, F.col("project_id") + 1).otherwise(F.col("project_id"))
    return linked.withColumn("project_id", moved)


def _changes(spark, sf_dir):
    described = op.infer_slug(_described(spark, sf_dir, 2).where(~op.is_filtered()))
    linked = op.link_entities(
        described.withColumn("content_hash", op.content_hash(F.col("text"))), entities(spark, sf_dir)
    )
    return op.classify_changes(linked, _stored(spark, sf_dir).select("source_id", "content_hash", "project_id"))


_STORED = (
    f"stored AS (SELECT source_id, sha256(text) AS content_hash, CASE WHEN entity_id % 3 = 0 THEN entity_id + 1 ELSE entity_id END AS project_id"
    f" FROM (SELECT *, {_SLUG} AS s FROM meta1 WHERE NOT {_FILTERED}) m LEFT JOIN entities e ON e.slug = m.s)"
)
_INCOMING = (
    f"incoming AS (SELECT source_id, sha256(text) AS content_hash, entity_id AS project_id"
    f" FROM (SELECT *, {_SLUG} AS s FROM meta2 WHERE NOT {_FILTERED}) m LEFT JOIN entities e ON e.slug = m.s)"
)
_BOTH = _with(1) + "," + _with(2)[5:] + f", {_ENTITIES}, {_STORED}, {_INCOMING}"
_CHANGED = (
    _BOTH + ", changes AS (SELECT i.source_id, i.content_hash, i.project_id,"
    " CASE WHEN s.source_id IS NULL THEN 'new' WHEN s.content_hash <> i.content_hash THEN 'changed'"
    " WHEN i.project_id IS NOT NULL AND i.project_id IS DISTINCT FROM s.project_id THEN 'relink'"
    " ELSE 'unchanged' END AS change FROM incoming i LEFT JOIN stored s USING (source_id))"
)


@query(_CHANGED + " SELECT source_id, change FROM changes")
def classify_changes(spark, sf_dir):
    return _changes(spark, sf_dir).select("source_id", "change")


@query(
    _CHANGED + " SELECT source_id, coalesce(content_hash, '') AS content_hash, coalesce(project_id, -1) AS project_id FROM ("
    "SELECT i.source_id, i.content_hash, i.project_id FROM changes i WHERE change IN ('new', 'changed')"
    " UNION ALL SELECT s.* FROM stored s WHERE source_id NOT IN (SELECT source_id FROM changes WHERE change IN ('new', 'changed')))"
)
def upsert_documents(spark, sf_dir):
    columns = ["source_id", "content_hash", "project_id"]
    due = _changes(spark, sf_dir).where(F.col("change").isin("new", "changed")).select(*columns)
    return op.upsert(_stored(spark, sf_dir).select(*columns), due, "source_id").withColumn(
        "project_id", F.coalesce("project_id", F.lit(-1))
    )


@query(
    _CHANGED + " SELECT source_id, coalesce(project_id, -1) AS project_id FROM ("
    "SELECT s.source_id, CASE WHEN c.change = 'relink' THEN c.project_id ELSE s.project_id END AS project_id"
    " FROM stored s LEFT JOIN changes c USING (source_id))"
)
def relink(spark, sf_dir):
    stored = _stored(spark, sf_dir)
    links = _changes(spark, sf_dir).where(F.col("change") == "relink").select("source_id", "project_id")
    chunks = stored.select("source_id", "project_id", F.col("source_id").alias("chunk_id"))
    documents, chunks = op.relink(stored.select("source_id", "project_id"), chunks, links)
    # Chunks must follow their documents; the join keeps a row only where they agree.
    return documents.join(
        chunks.select("source_id", F.col("project_id").alias("of_chunk")), "source_id"
    ).where(F.col("project_id").eqNullSafe(F.col("of_chunk"))).select(
        "source_id", F.coalesce("project_id", F.lit(-1)).alias("project_id")
    )


_PATHS = (
    "docs AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN doc_id END AS project_id,"
    " CASE WHEN doc_id % 3 = 0 THEN 'Knowledge/projects/doc' || doc_id || '.md'"
    " WHEN doc_id % 3 = 1 THEN 'knowledge/projects/doc' || doc_id || 'ReadMe.md' ELSE 'other/doc' || doc_id || '.md' END AS source_id FROM documents)"
)


@query(
    f"WITH {_PATHS}, {_ENTITIES}, linked AS (SELECT doc_id, source_id, coalesce(d.project_id, e.entity_id) AS project_id FROM docs d LEFT JOIN entities e"
    " ON lower(d.source_id) IN (lower('knowledge/projects/' || slug || '.md'), lower('knowledge/projects/' || slug || 'README.md')))"
    " SELECT 'document' AS kind, source_id, 0 AS chunk, coalesce(project_id, -1) AS project_id FROM linked"
    " UNION ALL SELECT 'chunk', source_id, c, coalesce(project_id, CASE c WHEN 1 THEN 7 ELSE -1 END) FROM linked, (VALUES (0), (1)) v(c)"
)
def backfill_links(spark, sf_dir):
    """Documents linked by file name, and their two chunks each, one with an old link of its own."""
    n = F.col("doc_id")
    name = F.concat(F.lit("doc"), n.cast("string"))
    documents = load(spark, sf_dir, "documents").select(
        F.when(n % 4 == 0, n).alias("project_id"),
        F.when(n % 3 == 0, F.concat(F.lit("Knowledge/projects/"), name, F.lit(".md")))
        .when(n % 3 == 1, F.concat(F.lit("knowledge/projects/"), name, F.lit("ReadMe.md")))
        .otherwise(F.concat(F.lit("other/"), name, F.lit(".md")))
        .alias("source_id"),
    )
    chunks = documents.select("source_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("chunk_id")).withColumn(
        "project_id", F.when(F.col("chunk_id") == 1, F.lit(7)).cast("long")
    )
    linked, aligned = op.backfill_links(documents, chunks, entities(spark, sf_dir))
    shown = lambda df, kind, chunk: df.select(
        F.lit(kind).alias("kind"), "source_id", chunk.alias("chunk"), F.coalesce("project_id", F.lit(-1)).alias("project_id")
    )
    return shown(linked, "document", F.lit(0)).unionByName(shown(aligned, "chunk", F.col("chunk_id")))


# --- chunking ------------------------------------------------------------------------

_STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
_SECTIONS = """
sections AS (
  SELECT source_id, title, embed_tags, doc_section, i AS section_no, headed,
    CASE WHEN NOT headed THEN doc_section WHEN doc_section <> '' THEN doc_section || ' > ' || h ELSE h END AS section, sbody
  FROM (
    SELECT source_id, title, embed_tags, section AS doc_section, i, headed,
      CASE WHEN headed THEN regexp_replace(regexp_replace(split_part(part, chr(10), 1), '^#+', ''), '^\\s+|\\s+$', '', 'g') END AS h,
      CASE WHEN headed THEN regexp_replace(substr(part, length(split_part(part, chr(10), 1)) + 1), '^\\s+|\\s+$', '', 'g') ELSE part END AS sbody
    FROM (
      SELECT source_id, coalesce(title, stem) AS title, embed_tags, section, unnest(parts) AS part, generate_subscripts(parts, 1) AS i, headed
      FROM (
        SELECT * REPLACE (CASE WHEN headed THEN list_transform(list_filter(pieces, lambda p: starts_with(p, '## ')), lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g')) ELSE [body] END AS parts)
        FROM (SELECT *, regexp_matches(body, '(?m)^## .') AS headed,
                     string_split(regexp_replace(body, '(?m)^## ', chr(1) || '## ', 'g'), chr(1)) AS pieces FROM meta1))))
),
paragraphs AS (
  SELECT *, list_filter(list_transform(regexp_split_to_array(sbody, '\\n\\s*\\n'), lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g')), lambda p: p <> '') AS ps FROM sections
),
packed AS (
  SELECT *, list_append(s.out, s.buf) AS packs FROM (
    SELECT *, list_reduce(list_transform(ps, lambda p: {'out': CAST([] AS VARCHAR[]), 'buf': p}), lambda a, x:
      CASE WHEN length(a.buf) + length(x.buf) + 2 <= 500 THEN {'out': a.out, 'buf': a.buf || chr(10) || chr(10) || x.buf}
           ELSE {'out': list_append(a.out, a.buf), 'buf': x.buf} END) AS s
    FROM paragraphs WHERE len(ps) > 0)
)"""
_CHUNKS = _SECTIONS + """,
pieces AS (
  SELECT source_id, title, embed_tags, doc_section, section, section_no, pack_no,
         CASE WHEN headed AND length(pack) > 500 THEN
           list_append(r.out, r.buf) ELSE [pack] END AS parts
  FROM (
    SELECT *, list_reduce(list_transform(regexp_extract_all(pack, '[^。！？\\n]*[。！？\\n]|[^。！？\\n]+'), lambda p: {'out': CAST([] AS VARCHAR[]), 'buf': p}), lambda a, x:
      CASE WHEN length(a.buf) + length(x.buf) > 500 THEN {'out': list_append(a.out, a.buf), 'buf': x.buf}
           ELSE {'out': a.out, 'buf': a.buf || x.buf} END) AS r
    FROM (SELECT *, unnest(packs) AS pack, generate_subscripts(packs, 1) AS pack_no FROM packed))
  WHERE length(pack) >= 50
),
chunks1 AS (
  SELECT source_id, title, embed_tags, doc_section, section, content, row_number() OVER (PARTITION BY source_id ORDER BY section_no, pack_no, piece_no) - 1 AS chunk_index
  FROM (SELECT *, regexp_replace(part, '^\\s+|\\s+$', '', 'g') AS content
        FROM (SELECT *, unnest(parts) AS part, generate_subscripts(parts, 1) AS piece_no FROM pieces))
  WHERE length(content) >= 50
)"""


def _sectioned(spark, sf_dir):
    return _described(spark, sf_dir).select(
        "source_id", F.posexplode(md.split_sections(F.col("body"), F.col("doc_section"))).alias("section_no", "s")
    ).select("source_id", (F.col("section_no") + 1).alias("section_no"), "s.*")


@query(_with() + "," + _SECTIONS + " SELECT source_id, section_no, section, md5(sbody) AS body_md5 FROM sections")
def sections(spark, sf_dir):
    return _sectioned(spark, sf_dir).select("source_id", "section_no", "section", F.md5("body").alias("body_md5"))


@query(
    _with() + "," + _SECTIONS + " SELECT source_id, section_no, len(ps) AS n, md5(array_to_string(ps, '|')) AS joined FROM paragraphs"
)
def paragraphs(spark, sf_dir):
    split = md.split_paragraphs(F.col("body"))
    return _sectioned(spark, sf_dir).select(
        "source_id", "section_no", F.size(split).alias("n"), F.md5(F.array_join(split, "|")).alias("joined")
    )


@query(
    _with() + "," + _SECTIONS + " SELECT source_id, section_no, len(packs) AS n, md5(array_to_string(packs, '|')) AS joined FROM packed"
)
def pack_paragraphs(spark, sf_dir):
    packs = md.pack_paragraphs(md.split_paragraphs(F.col("body")))
    return _sectioned(spark, sf_dir).withColumn("packs", packs).where(F.size("packs") > 0).select(
        "source_id", "section_no", F.size("packs").alias("n"), F.md5(F.array_join("packs", "|")).alias("joined")
    )


@query(
    "SELECT doc_id, len(parts) AS n, md5(array_to_string(parts, '|')) AS joined FROM ("
    "SELECT doc_id, list_transform(list_append(r.out, r.buf), lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g')) AS parts FROM ("
    "SELECT doc_id, list_reduce(list_transform(regexp_extract_all(text, '[^。！？\\n]*[。！？\\n]|[^。！？\\n]+'), lambda p: {'out': CAST([] AS VARCHAR[]), 'buf': p}), lambda a, x:"
    " CASE WHEN length(a.buf) + length(x.buf) > 500 THEN {'out': list_append(a.out, a.buf), 'buf': x.buf}"
    " ELSE {'out': a.out, 'buf': a.buf || x.buf} END) AS r FROM documents))"
)
def split_long(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", md.split_long(F.col("text")).alias("p")).select(
        "doc_id", F.size("p").alias("n"), F.md5(F.array_join("p", "|")).alias("joined")
    )


def chunked(spark, sf_dir):
    return op.chunk_documents(_described(spark, sf_dir))


@query(
    _with() + "," + _CHUNKS + " SELECT source_id, chunk_index, section, md5(content) AS content_md5,"
    " length(content) AS token_count FROM chunks1"
)
def chunk_documents(spark, sf_dir):
    return chunked(spark, sf_dir).select(
        "source_id", "chunk_index", "section", F.md5("content").alias("content_md5"), "token_count"
    )


#: The chunks of the second edition, by the same statements.
_CHUNKS2 = re.sub(r"\b(sections|paragraphs|packed|pieces)\b", r"\g<1>2", _CHUNKS).replace("meta1", "meta2").replace("chunks1", "chunks2")


@query(
    _BOTH + "," + _CHUNKS + " SELECT source_id, count(chunk_index) AS n_chunks FROM stored LEFT JOIN chunks1 USING (source_id)"
    " WHERE source_id IN (SELECT source_id FROM incoming) GROUP BY 1"
)
def drop_orphans(spark, sf_dir):
    """Stored documents that are still processed, with their chunks; an outer join, so chunks without a document would show."""
    stored = _stored(spark, sf_dir).select("source_id")
    chunks = chunked(spark, sf_dir).select("source_id", "chunk_index").join(stored, "source_id", "left_semi")
    kept, kept_chunks, _ = op.drop_orphans(stored, chunks, _changes(spark, sf_dir).select("source_id"))
    counts = kept_chunks.groupBy("source_id").agg(F.count("*").alias("n"))
    return kept.join(counts, "source_id", "full").select("source_id", F.coalesce("n", F.lit(0)).alias("n_chunks"))


@query(
    _with() + "," + _CHUNKS + " SELECT source_id, chunk_index, md5('文档：' || title || CASE WHEN section <> '' THEN chr(10) || '章节：' || section"
    " WHEN doc_section <> '' THEN chr(10) || '章节：' || doc_section ELSE '' END"
    " || CASE WHEN len(embed_tags) > 0 AND array_to_string(embed_tags, '、') <> '' THEN chr(10) || '标签：' || array_to_string(embed_tags, '、') ELSE '' END"
    " || chr(10) || chr(10) || content) AS embed_md5 FROM chunks1"
)
def embed_text(spark, sf_dir):
    return chunked(spark, sf_dir).select("source_id", "chunk_index", F.md5("embed_text").alias("embed_md5"))


# The checksum of a word, bit by bit, as the hashing provider takes it.
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(w, ''), lambda ch: ascii(ch)::BIGINT)),
  lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
    lambda bits, _: xor(bits >> 1, 3988292384 * (bits & 1)))), 4294967295)"""


@query(
    f"""WITH words AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[0-9a-z]+')) AS w FROM documents),
codes AS (SELECT w, {_CRC} AS code FROM (SELECT DISTINCT w FROM words)),
sums AS (
  SELECT doc_id, code % 64 AS d, sum(CASE WHEN code >= 2147483648 THEN 1 ELSE -1 END) AS v FROM words JOIN codes USING (w) GROUP BY ALL HAVING v <> 0
), tops AS (SELECT doc_id, arg_max(d, (abs(v), -d)) AS top, arg_max(v, (abs(v), -d)) > 0 AS up FROM sums GROUP BY 1)
SELECT doc_id, 64 AS dimensions, CASE WHEN top IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS norm, coalesce(top + 1, 0) AS top_dimension, coalesce(up, false) AS top_up
FROM documents LEFT JOIN tops USING (doc_id)"""
)
def embed_documents(spark, sf_dir):
    """Vectors of whole documents: their length (one unless the text has no words), and their largest dimension with its sign."""
    vectors = embed(load(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    norm = F.aggregate("embedding", F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double") * x.cast("double"))
    sizes = F.transform("embedding", F.abs)
    top = F.when(F.array_max(sizes) > 0, F.array_position(sizes, F.array_max(sizes))).otherwise(0)
    return vectors.select(
        "doc_id", F.size("embedding").alias("dimensions"), F.round(F.sqrt(norm), 4).alias("norm"), top.alias("top_dimension"),
        F.when(top > 0, F.element_at("embedding", F.greatest(top, F.lit(1)).cast("int")) > 0).otherwise(False).alias("top_up"),
    )


@query(
    _CHANGED + "," + _CHUNKS + "," + _CHUNKS2 + ", touched AS (SELECT source_id FROM changes WHERE change IN ('new', 'changed'))"
    " SELECT source_id, chunk_index, section, md5(content) AS content_md5 FROM chunks1 WHERE source_id NOT IN (SELECT source_id FROM touched)"
    " UNION ALL SELECT source_id, chunk_index, section, md5(content) FROM chunks2 WHERE source_id IN (SELECT source_id FROM touched)"
)
def replace_chunks(spark, sf_dir):
    """Touched documents get the chunks of their second edition, the others keep theirs."""
    columns = ["source_id", "chunk_index", "section", "content"]
    touched = _changes(spark, sf_dir).where(F.col("change").isin("new", "changed"))
    fresh = op.chunk_documents(touched).select(*columns)
    return op.replace_chunks(chunked(spark, sf_dir).select(*columns), fresh, touched).select(
        "source_id", "chunk_index", "section", F.md5("content").alias("content_md5")
    )


def _report_sql(changes, stored, editions=2):
    """The counts of a run over files with their ``change`` (null: filtered) against ``stored``."""
    return f"""
SELECT count(*) AS files_scanned, count(*) FILTER (change IS NULL OR (change IN ('new', 'changed') AND n = 0)) AS files_skipped_filter,
       count(*) FILTER (change IN ('unchanged', 'relink')) AS files_skipped_hash,
       count(*) FILTER (change IN ('new', 'changed') AND n > 0) AS files_processed,
       CAST(coalesce(sum(n) FILTER (change IN ('new', 'changed')), 0) AS BIGINT) AS chunks_new, count(*) FILTER (change = 'relink') AS links_updated, 0 AS errors,
       (SELECT count(*) FROM {stored} WHERE source_id NOT IN (SELECT source_id FROM {changes} WHERE change IS NOT NULL)) AS docs_deleted
FROM (SELECT source_id, change, coalesce(n, 0) AS n FROM {changes}
      LEFT JOIN (SELECT source_id, count(*) AS n FROM chunks{editions} GROUP BY 1) USING (source_id))"""


@query(
    _CHANGED + "," + _CHUNKS2 + ", seen AS (SELECT source_id, change FROM meta2 LEFT JOIN changes USING (source_id))" + _report_sql("seen", "stored")
)
def ingest_report(spark, sf_dir):
    """Counts of the second edition against the stored first one: its chunks, moved links and what it no longer holds."""
    stored = _stored(spark, sf_dir).select("source_id", "content_hash", "project_id")
    seen = job.classify(files(spark, sf_dir, 2), stored, entities(spark, sf_dir))
    due = _changes(spark, sf_dir).where(F.col("change").isin("new", "changed"))
    counts = op.chunk_documents(due).groupBy("source_id").agg(F.count("*").alias("n_chunks"))
    gone = op.orphans(stored, seen.where(~F.col("filtered")).select("source_id"))
    return op.ingest_report(seen, counts, gone.agg(F.count("*").alias("docs_deleted")))


_RUNS = (
    _with(1) + "," + _with(2)[5:] + f", {_ENTITIES}," + _CHUNKS + "," + _CHUNKS2 + f""",
first AS (SELECT source_id, CASE WHEN NOT {_FILTERED} THEN 'new' END AS change FROM meta1),
none AS (SELECT source_id FROM first WHERE false),
kept AS (
  SELECT source_id, sha256(text) AS content_hash, entity_id AS project_id, coalesce(type, 'profile') AS document_type
  FROM (SELECT *, {_SLUG} AS s FROM meta1 WHERE NOT {_FILTERED} AND source_id IN (SELECT source_id FROM chunks1)) m LEFT JOIN entities e ON e.slug = m.s
),
second AS (
  SELECT m.source_id, CASE WHEN {_FILTERED} THEN NULL WHEN k.source_id IS NULL THEN 'new' WHEN k.content_hash <> sha256(m.text) THEN 'changed'
    WHEN e.entity_id IS NOT NULL AND e.entity_id + 1 IS DISTINCT FROM k.project_id THEN 'relink' ELSE 'unchanged' END AS change
  FROM (SELECT *, {_SLUG} AS s FROM meta2) m LEFT JOIN entities e ON e.slug = m.s LEFT JOIN kept k ON k.source_id = m.source_id
)"""
)


@query(
    _RUNS + " SELECT 1 AS run, * FROM (" + _report_sql("first", "none", 1) + ") UNION ALL SELECT 2 AS run, * FROM (" + _report_sql("second", "kept") + ")"
)
def ingest_job(spark, sf_dir):
    """The whole job twice on a bucketed store: the first edition into an empty one, then the second with moved entities."""
    target = runs.new_folder(spark, "ingest-job")
    first = job.run_ingest(files(spark, sf_dir), entities(spark, sf_dir), target, buckets=8)
    second = job.run_ingest(files(spark, sf_dir, 2), entities(spark, sf_dir, shift=1), target, buckets=8)
    return first.withColumn("run", F.lit(1)).unionByName(second.withColumn("run", F.lit(2)))


#: What the stream of the first edition stores, by document type.
STREAMED_SQL = _RUNS + (
    " SELECT document_type, count(DISTINCT source_id) AS documents, count(*) AS chunks FROM kept JOIN chunks1 USING (source_id) GROUP BY 1"
)


# --- validation ----------------------------------------------------------------------

_RULES = _with() + """,
usable AS (SELECT * FROM meta1 WHERE header <> ''),
findings AS (
  SELECT source_id, 'error' AS level, 'header' AS rule, CASE WHEN starts_with(text, '---') THEN 'empty' ELSE 'missing' END AS detail
  FROM meta1 WHERE header = ''
  UNION ALL SELECT source_id, 'error', 'required', f FROM (
    SELECT source_id, unnest(list_filter([CASE WHEN id IS NULL THEN 'id' END, CASE WHEN title IS NULL THEN 'title' END,
      CASE WHEN type IS NULL THEN 'type' END, CASE WHEN visibility IS NULL THEN 'visibility' END,
      CASE WHEN confidence IS NULL THEN 'confidence' END], lambda x: x IS NOT NULL)) AS f FROM usable)
  UNION ALL SELECT source_id, 'error', 'id_empty', '' FROM usable WHERE id IS NULL
  UNION ALL SELECT source_id, 'warning', 'type', type FROM usable WHERE type NOT IN ('profile', 'project', 'skill', 'experience', 'faq')
  UNION ALL SELECT source_id, 'error', 'visibility', visibility FROM usable WHERE visibility NOT IN ('public', 'private')
  UNION ALL SELECT source_id, 'error', 'confidence', confidence FROM usable WHERE confidence NOT IN ('confirmed', 'self_reported', 'unverified')
  UNION ALL SELECT source_id, 'warning', 'body_empty', '' FROM usable WHERE body = ''
  UNION ALL SELECT source_id, 'error', 'id_repeated', id || ' ' || f FROM (
    SELECT source_id, id, min(source_id) OVER (PARTITION BY id) AS f FROM usable WHERE id IS NOT NULL) WHERE source_id <> f
)"""


@query(_RULES + " SELECT * FROM findings")
def validate_corpus(spark, sf_dir):
    return validation.validate_corpus(files(spark, sf_dir))


@query(
    _RULES + " SELECT count(*) FILTER (level = 'error') AS errors, count(*) FILTER (level = 'warning') AS warnings,"
    " count(*) FILTER (level = 'error') = 0 AS passed FROM findings"
)
def validation_report(spark, sf_dir):
    return validation.validation_report(validation.validate_corpus(files(spark, sf_dir)))
