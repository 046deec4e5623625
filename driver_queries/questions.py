"""Routing, evidence gates, text safety, FAQ and answer routes over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from driver_queries.registry import Registry
from driver_queries.retrieval import HYBRID_SQL, general_evidence
from driver_queries.tables import chunks, load, questions as benchmark_questions
from evidentia import fixed_values as fixed
from evidentia.functions import safety as sf, text as tx
from evidentia.functions.text import normalize_key
from evidentia.operators import evidence as ev, faq, fusion, html, routing
from evidentia.operators.substring_join import substring_join
from evidentia.plans.answer import route_answers as plan_answers
from evidentia.plans.retrieval import retrieve_targets
from evidentia.session import broadcast_if_small, holds_at_most

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

# Rules that fit the invented prose of the tables.
RULES = routing.RoutingRules(
    entity_word="tion",
    list_request="wh",
    all_entities="(?:the|les).{0,4}tion",
    detail_request="ing|ment",
    facets=(
        ("scope", "the scope", ("src1", "src2"), "ou"),
        ("role", "of role", ("src3",), "erst|heit"),
        ("method", "in method", ("src4", "src5"), "ble"),
    ),
    default_facets=2,
    clause_breaks=r"[;；]|\. ",
    clause_filler=r"^(The|En|In)",
    clause_edge=" .,",
    domain_query="about {domain}",
)
DOMAINS = (("endings", "keit"), ("endings", "heit"), ("articles", "une"), ("articles", "der"), ("verbs", "ist"))


def dialogue_questions(spark, sf_dir):
    """User turns as questions."""
    return load(spark, sf_dir, "conversations").where(F.col("role") == "user").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), F.col("text").alias("question")
    )


def entities(spark, sf_dir):
    """One entity per benchmark passage, called by its second word; its sixth word is an alias."""
    words = F.split("text", " ")
    return load(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("entity_id"),
        F.concat(F.lit("item_"), F.col("item_id").cast("string")).alias("slug"),
        F.get(words, F.lit(1)).alias("title"),
        F.get(words, F.lit(5)).alias("alias"),
        (1000 - F.col("item_id")).cast("int").alias("sort_order"),
    )


def aliases(spark, sf_dir):
    return entities(spark, sf_dir).select("slug", "alias")


def domains(spark):
    rows = [(label, alias, n) for n, (label, alias) in enumerate(DOMAINS)]
    order = {}
    return spark.createDataFrame(
        [(label, alias, order.setdefault(label, n)) for label, alias, n in rows],
        "label string, alias string, sort_order int",
    )


_NORM = "regexp_replace(lower({0}), '[^0-9a-z\\x{{4e00}}-\\x{{9fff}}]+', '', 'g')"
_ROUTING = f"""WITH questions AS (SELECT conv_id * 1000 + turn AS question_id, text AS question FROM conversations WHERE role = 'user'),
entities AS (
  SELECT item_id AS entity_id, 'item_' || item_id AS slug, string_split(text, ' ')[2] AS title, string_split(text, ' ')[6] AS alias,
         1000 - item_id AS sort_order FROM benchmark
),
mentions AS (
  SELECT question_id, entity_id, slug, title, sort_order FROM questions, entities
  WHERE contains({_NORM.format('question')}, {_NORM.format('title')}) OR contains({_NORM.format('question')}, {_NORM.format('slug')})
     OR contains({_NORM.format('question')}, {_NORM.format('alias')})
),
domains(label, alias, pos) AS (VALUES ('endings', 'keit', 0), ('endings', 'heit', 0), ('articles', 'une', 2), ('articles', 'der', 2), ('verbs', 'ist', 4)),
found_domains AS (
  SELECT question_id, list(label ORDER BY pos) AS domains FROM (
    SELECT DISTINCT question_id, label, pos FROM questions, domains WHERE contains(lower(question), alias)) GROUP BY 1
),
found AS (
  SELECT question_id, list({{'sort_order': sort_order, 'entity_id': entity_id, 'slug': slug, 'title': title}} ORDER BY sort_order) AS es FROM mentions GROUP BY 1
),
catalogue AS (SELECT list({{'sort_order': sort_order, 'entity_id': entity_id, 'slug': slug, 'title': title}} ORDER BY sort_order) AS es FROM entities),
clauses AS (
  SELECT question_id, list(c ORDER BY i) AS clauses FROM (
    SELECT question_id, c, min(i) AS i FROM (
      SELECT question_id, i, regexp_replace(regexp_replace(part, '^[ .,]+|[ .,]+$', '', 'g'), '^(The|En|In)', '') AS c
      FROM (SELECT question_id, unnest(regexp_split_to_array(question, '[;；]|\\. ')) AS part, generate_subscripts(regexp_split_to_array(question, '[;；]|\\. '), 1) AS i FROM questions))
    WHERE length(c) >= 3 GROUP BY 1, 2)
  GROUP BY 1 HAVING count(*) >= 2
),
signals AS (
  SELECT *, contains(lower(question), 'tion') AS w, contains(lower(question), 'wh') AS l,
    regexp_matches(lower(question), '(?s)(?:the|les)[^\\n]{{0,4}}tion') AS a, regexp_matches(lower(question), 'ing|ment') AS d FROM questions
),
facet_list AS (
  SELECT question_id, list_filter([
    CASE WHEN regexp_matches(question, '(?i)ou') THEN {{'label': 'scope', 'terms': 'the scope', 's': 'src1|src2'}} END,
    CASE WHEN regexp_matches(question, '(?i)erst|heit') THEN {{'label': 'role', 'terms': 'of role', 's': 'src3'}} END,
    CASE WHEN regexp_matches(question, '(?i)ble') THEN {{'label': 'method', 'terms': 'in method', 's': 'src4|src5'}} END], lambda f: f IS NOT NULL) AS asked FROM questions
),
facets AS (
  SELECT question_id, CASE WHEN len(asked) > 0 THEN asked ELSE [{{'label': 'scope', 'terms': 'the scope', 's': 'src1|src2'}}, {{'label': 'role', 'terms': 'of role', 's': 'src3'}}] END AS fs FROM facet_list
),
plans AS (
  SELECT *, CASE WHEN intent IN ('multi_project', 'single_project') THEN len(chosen) * len(fs) WHEN intent = 'multi_part' THEN len(parts) WHEN intent = 'project_list' THEN n_all ELSE 0 END AS n FROM (
    SELECT *, CASE intent WHEN 'multi_project' THEN CASE WHEN w AND a THEN all_es ELSE es END WHEN 'single_project' THEN es END AS chosen,
      CASE WHEN intent = 'multi_part' THEN CASE WHEN nd >= 2 THEN list_transform(ds, lambda x: x) ELSE cs END END AS parts FROM (
      SELECT s.*, f.es, d.domains AS ds, c.clauses AS cs, k.es AS all_es, len(k.es) AS n_all, x.fs, coalesce(len(d.domains), 0) AS nd,
        CASE WHEN w AND l AND NOT s.d THEN 'project_list' WHEN (w AND a AND len(k.es) > 0) OR coalesce(len(f.es), 0) >= 2 THEN 'multi_project'
             WHEN len(f.es) = 1 THEN 'single_project' WHEN coalesce(len(d.domains), 0) >= 2 OR c.clauses IS NOT NULL THEN 'multi_part' ELSE 'general' END AS intent
      FROM signals s LEFT JOIN found f USING (question_id) LEFT JOIN found_domains d USING (question_id) LEFT JOIN clauses c USING (question_id)
           JOIN facets x USING (question_id), catalogue k))
),
targets AS (
  SELECT question_id, e.title || '：' || f.terms AS query, e.title || '/' || f.label AS coverage_key, e.slug AS project_slug, f.s AS section_terms, e.sort_order AS o1, fi AS o2
  FROM (SELECT question_id, e, unnest(fs) AS f, generate_subscripts(fs, 1) AS fi FROM (SELECT question_id, unnest(chosen) AS e, fs FROM plans WHERE chosen IS NOT NULL))
  UNION ALL SELECT question_id, CASE WHEN nd >= 2 THEN 'about ' || p ELSE p END, p, '', '', i, 0 FROM (SELECT question_id, nd, unnest(parts) AS p, generate_subscripts(parts, 1) AS i FROM plans WHERE parts IS NOT NULL)
  UNION ALL SELECT question_id, question, 'general', '', '', 0, 0 FROM plans WHERE intent = 'general'
)"""


@query(_ROUTING + " SELECT question_id, entity_id FROM mentions")
def entity_mentions(spark, sf_dir):
    found = routing.mentioned_entities(dialogue_questions(spark, sf_dir), entities(spark, sf_dir), aliases(spark, sf_dir))
    return found.select("question_id", F.explode("entities.entity_id").alias("entity_id"))


@query(_ROUTING + " SELECT question_id, w AS has_entity_word, l AS list_request, a AS all_entities, d AS detail_request FROM signals")
def question_signals(spark, sf_dir):
    return routing.question_signals(dialogue_questions(spark, sf_dir), RULES).drop("question")


@query(_ROUTING + " SELECT question_id, array_to_string(list_transform(fs, lambda f: f.label), '|') AS facets FROM facets")
def facets(spark, sf_dir):
    asked = dialogue_questions(spark, sf_dir)
    return asked.select("question_id", F.array_join(routing.match_facets(F.col("question"), RULES)["label"], "|").alias("facets"))


@query(_ROUTING + " SELECT question_id, array_to_string(domains, '|') AS domains FROM found_domains")
def match_domains(spark, sf_dir):
    found = routing.match_domains(dialogue_questions(spark, sf_dir), domains(spark))
    return found.select("question_id", F.array_join("domains", "|").alias("domains"))


@query(_ROUTING + " SELECT question_id, array_to_string(clauses, '|') AS clauses FROM clauses")
def clauses(spark, sf_dir):
    split = routing.split_clauses(F.col("question"), RULES)
    return dialogue_questions(spark, sf_dir).select("question_id", split.alias("c")).where(F.size("c") > 0).select(
        "question_id", F.array_join("c", "|").alias("clauses")
    )


def plans(spark, sf_dir):
    return routing.route_questions(
        dialogue_questions(spark, sf_dir), entities(spark, sf_dir), aliases(spark, sf_dir), domains(spark), RULES
    )


@query(
    _ROUTING + " SELECT question_id, intent, intent IN ('project_list', 'multi_project', 'multi_part') AS requires_coverage,"
    " CASE intent WHEN 'project_list' THEN greatest(5, n) WHEN 'multi_project' THEN least(16, greatest(6, n))"
    " WHEN 'single_project' THEN least(8, greatest(5, 2 * n)) WHEN 'multi_part' THEN least(10, greatest(6, 2 * n)) ELSE 5 END AS context_limit FROM plans"
)
def route_questions(spark, sf_dir):
    return plans(spark, sf_dir).select("question_id", "intent", "requires_coverage", "context_limit")


@query(
    _ROUTING + " SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY o1, o2) AS target_no, query, coverage_key, project_slug, section_terms FROM targets"
)
def expand_targets(spark, sf_dir):
    return routing.expand_targets(plans(spark, sf_dir), RULES).select(
        "question_id", "target_no", "query", "coverage_key",
        F.coalesce("project_slug", F.lit("")).alias("project_slug"), F.array_join("section_terms", "|").alias("section_terms"),
    )


def catalogue(spark, sf_dir):
    """part rows as a catalogue."""
    n = F.col("p_partkey")
    return load(spark, sf_dir, "part").select(
        n.alias("entity_id"), F.concat(F.lit("p"), n.cast("string")).alias("slug"), F.col("p_name").alias("title"),
        F.col("p_size").alias("sort_order"), F.when(F.col("p_type") == "SMALL", "private").otherwise("public").alias("visibility"),
        F.timestamp_seconds(F.lit(1700000000) + n).alias("created_at"),
    )


@query(
    "WITH RECURSIVE " + _ROUTING[5:] + ", lines AS (SELECT string_agg(k || '. ' || p_name, chr(10) ORDER BY k) AS content FROM ("
    "SELECT p_name, row_number() OVER (ORDER BY p_size, p_partkey, p_name) AS k FROM part WHERE p_type <> 'SMALL'))"
    " SELECT question_id, md5(content) AS content_md5, 1.0::DOUBLE AS score FROM plans, lines WHERE intent = 'project_list'"
)
def list_answer(spark, sf_dir):
    public = catalogue(spark, sf_dir).where(F.col("visibility") == "public")
    return routing.list_answer(plans(spark, sf_dir), public, digest="md5").select(
        "question_id", F.col("content").alias("content_md5"), "score"
    )


@query("SELECT 'p' || p_partkey AS slug FROM part WHERE p_type <> 'SMALL' ORDER BY p_size, p_partkey DESC LIMIT 4")
def catalogue_public(spark, sf_dir):
    return routing.public_entities(catalogue(spark, sf_dir), 4).select("slug")


@query("SELECT p_partkey AS entity_id, p_name AS title FROM part WHERE p_type <> 'SMALL' AND p_partkey = 3")
def entity_by_slug(spark, sf_dir):
    return routing.entity_by_slug(catalogue(spark, sf_dir), "p3").select("entity_id", "title")


# --- cascade and coverage ------------------------------------------------------------


def cascade_targets(spark, sf_dir):
    """Benchmark passages with an entity filter and a section filter that some cannot meet."""
    vectors = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding", "label")
    n = F.col("item_id")
    return load(spark, sf_dir, "benchmark").join(vectors, "item_id", "left").select(
        F.floor(n / 4).alias("question_id"),
        ((n % 4) + 1).cast("int").alias("target_no"),
        n.alias("target_id"),
        F.col("text").alias("query"),
        "embedding",
        F.concat(F.lit("key"), (n % 3).cast("string")).alias("coverage_key"),
        F.when(n % 5 != 0, F.col("label")).alias("project_id"),
        F.when(n % 3 == 0, F.array(F.concat(F.lit("src"), (n % 25).cast("string"))))
        .when(n % 3 == 1, F.array(F.lit("s_c2"), F.lit("none")))
        .otherwise(F.array().cast("array<string>"))
        .alias("section_terms"),
        F.lit(True).alias("requires_coverage"),
    )


def cascade_plans(spark, sf_dir):
    return cascade_targets(spark, sf_dir).groupBy("question_id").agg(
        F.lit(True).alias("requires_coverage"),
        F.array_sort(F.collect_set("coverage_key")).alias("expected_coverage"),
        F.lit(3).alias("context_limit"),
    )


def _cascade_sql():
    from driver_queries.tables import CHUNKS_SQL

    like = lambda f: f"c.{f} ILIKE '%' || t.term || '%' ESCAPE '\\'"
    parts = [
        f"WITH {CHUNKS_SQL}, targets AS (SELECT item_id // 4 AS question_id, item_id % 4 + 1 AS target_no, item_id AS target_id, b.text AS query,"
        " CAST(e.embedding AS DOUBLE[]) AS embedding, 'key' || (item_id % 3) AS coverage_key, CASE WHEN item_id % 5 <> 0 THEN e.label END AS project_id,"
        " CASE item_id % 3 WHEN 0 THEN ['src' || (item_id % 25)] WHEN 1 THEN ['s_c2', 'none'] ELSE CAST([] AS VARCHAR[]) END AS section_terms"
        " FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id),"
        " terms AS (SELECT target_id, term FROM (SELECT target_id, term, row_number() OVER (PARTITION BY target_id ORDER BY length(term) DESC, term) AS n"
        " FROM (SELECT DISTINCT target_id, unnest(regexp_extract_all(lower(query), '[a-z][a-z0-9_-]+')) AS term FROM targets)) WHERE n <= 12),"
        " sims AS (SELECT t.target_id, c.chunk_id, list_cosine_similarity(t.embedding, c.embedding) AS sim FROM targets t, corpus c WHERE c.embedding IS NOT NULL),"
        " raws AS (SELECT * FROM (SELECT t.target_id, c.chunk_id, sum("
        f"CASE WHEN {like('title')} THEN 2.0 ELSE 0.0 END + CASE WHEN {like('section')} THEN 1.5 ELSE 0.0 END + CASE WHEN {like('content')} THEN 1.0 ELSE 0.0 END)::DOUBLE AS raw,"
        " count(*) AS n_terms FROM terms t, corpus c GROUP BY 1, 2) WHERE raw > 0)"
    ]
    section = "len(list_filter(t.section_terms, lambda s: c.section ILIKE '%' || s || '%' ESCAPE '\\')) > 0"
    entity = "(t.project_id IS NULL OR c.project_id = t.project_id)"
    filters = {
        1: f"{entity} AND (len(t.section_terms) = 0 OR {section})",
        2: f"len(t.section_terms) > 0 AND {entity}",
        3: f"t.project_id IS NOT NULL AND (len(t.section_terms) = 0 OR {section})",
    }
    for n, condition in filters.items():
        parts.append(
            f", v{n} AS (SELECT * FROM (SELECT x.target_id, x.chunk_id, sim, row_number() OVER (PARTITION BY x.target_id ORDER BY sim DESC, x.chunk_id) AS vrank"
            f" FROM sims x JOIN targets t USING (target_id) JOIN corpus c USING (chunk_id) WHERE {condition}) WHERE vrank <= 8),"
            f" l{n} AS (SELECT * FROM (SELECT x.target_id, x.chunk_id, least(1.0, raw / greatest(1.0, 4.5 * n_terms)) AS lex, row_number() OVER (PARTITION BY x.target_id ORDER BY raw DESC, x.chunk_id) AS lrank"
            f" FROM raws x JOIN targets t USING (target_id) JOIN corpus c USING (chunk_id) WHERE {condition}) WHERE lrank <= 8),"
            f" f{n} AS (SELECT {n} AS pass, target_id, chunk_id, greatest(0.0, least(1.0, coalesce(sim, 0))) AS v, coalesce(lex, 0.0) AS l, vrank, lrank FROM v{n} FULL JOIN l{n} USING (target_id, chunk_id))"
        )
    parts.append(
        ", fused AS (SELECT * FROM f1 UNION ALL SELECT * FROM f2 UNION ALL SELECT * FROM f3),"
        " boosted AS (SELECT f.*, c.document_id, least(1.0, greatest(v, 0.85 * l) + CASE WHEN len(list_filter(c.tags, lambda g: contains(regexp_replace(lower(t.query), '[^0-9a-z]+', '', 'g'), g))) > 0 THEN 0.10 ELSE 0.0 END"
        " + CASE WHEN c.project_id IS NOT NULL AND contains(lower(t.query), 'project') THEN 0.05 ELSE 0.0 END) AS b"
        " FROM fused f JOIN corpus c USING (chunk_id) JOIN targets t USING (target_id)),"
        " scored AS (SELECT *, CASE WHEN vrank IS NOT NULL AND lrank IS NOT NULL THEN least(1.0, b + 0.04 * ((1.0 / (60 + vrank) + 1.0 / (60 + lrank)) / (2.0 / 61))) ELSE b END AS s FROM boosted),"
        " kept AS (SELECT *, round(s, 4) AS score, min(pass) OVER (PARTITION BY target_id) AS first_pass FROM scored WHERE s >= 0.3),"
        " capped AS (SELECT *, row_number() OVER (PARTITION BY target_id, document_id ORDER BY score DESC, vrank NULLS LAST, lrank NULLS LAST, chunk_id) AS per_doc FROM kept WHERE pass = first_pass),"
        " ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY score DESC, vrank NULLS LAST, lrank NULLS LAST, chunk_id) AS position FROM capped WHERE per_doc <= 2) WHERE position <= 4),"
        " merged AS (SELECT question_id, chunk_id, max(score) AS score, array_to_string(list_sort(list_distinct(list(coverage_key))), '|') AS coverage_keys, min(target_no * 100 + position) AS seen"
        " FROM ranked JOIN targets USING (target_id) WHERE position <= 1 GROUP BY 1, 2),"
        " evidence AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, seen, chunk_id) AS rank FROM merged) WHERE rank <= 3)"
    )
    return "".join(parts)


CASCADE_SQL = _cascade_sql()


@query(CASCADE_SQL + " SELECT target_id, pass AS pass_no, position, chunk_id, score FROM ranked")
def retrieval_cascade(spark, sf_dir):
    targets = fusion.target_quota(cascade_targets(spark, sf_dir), 10)
    return retrieve_targets(targets, chunks(spark, sf_dir), max_k=4, min_score=0.3).select(
        "target_id", "pass_no", "position", "chunk_id", "score"
    )


def cascade_evidence(spark, sf_dir):
    from evidentia.plans.retrieval import retrieve

    plan = cascade_plans(spark, sf_dir)
    targets = cascade_targets(spark, sf_dir).drop("requires_coverage")
    return plan, *retrieve(plan, targets, chunks(spark, sf_dir), top_k=10, min_score=0.3)


@query(
    CASCADE_SQL + ", expected AS (SELECT question_id, list_sort(list_distinct(list(coverage_key))) AS ks FROM targets GROUP BY 1),"
    " covered AS (SELECT question_id, list_distinct(flatten(list(string_split(coverage_keys, '|')))) AS cs FROM evidence GROUP BY 1)"
    " SELECT question_id, rank, chunk_id, score, coverage_keys,"
    " array_to_string(list_filter(ks, lambda k: NOT list_contains(coalesce(cs, []), k)), '|') AS missing"
    " FROM evidence JOIN expected USING (question_id) JOIN covered USING (question_id)"
)
def merge_coverage(spark, sf_dir):
    _, evidence, missing = cascade_evidence(spark, sf_dir)
    return evidence.join(missing, "question_id").select(
        "question_id", "rank", "chunk_id", "score", F.array_join("coverage_keys", "|").alias("coverage_keys"),
        F.array_join("missing", "|").alias("missing"),
    )


@query(
    "WITH q AS (SELECT item_id, text FROM benchmark), a(canonical, alias) AS (SELECT string_split(text, ' ')[2], string_split(text, ' ')[6] FROM benchmark),"
    " n AS (SELECT regexp_replace(lower(canonical), '[^0-9a-z]+', '', 'g') AS canonical, regexp_replace(lower(alias), '[^0-9a-z]+', '', 'g') AS alias FROM a),"
    " m AS (SELECT DISTINCT item_id, canonical FROM q, n WHERE contains(regexp_replace(lower(text), '[^0-9a-z]+', '', 'g'), alias))"
    " SELECT item_id, doc_id, count(*) > 0 AS boosted FROM m JOIN documents d ON contains(regexp_replace(lower(split_part(d.text, chr(10), 1)), '[^0-9a-z]+', '', 'g'), canonical)"
    " GROUP BY 1, 2"
)
def title_boost(spark, sf_dir):
    """All pairs of a question and a document whose title names an entity that the question mentions."""
    asked = load(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("query"))
    names = entities(spark, sf_dir).select(F.col("title").alias("canonical"), "alias")
    titles = load(spark, sf_dir, "documents").select("doc_id", F.substring_index("text", "\n", 1).alias("title"))
    titles = titles.withColumn("key", normalize_key(F.col("title"))).distinct()
    titles = titles.withColumn("row", F.md5(F.concat_ws("#", F.col("doc_id").cast("string"), F.col("doc_id").isNull().cast("string"), "title")))
    mentioned = fusion.mentioned_names(asked, names, "item_id")
    wanted = mentioned.select("item_id", F.explode("mentioned").alias("name"))
    # Only keys of titles and questions are paired; texts follow for the distinct pairs.
    named = substring_join(titles, "key", wanted.select("name").distinct(), "name", key="row").select("row", "name")
    pairs = named.join(broadcast_if_small(wanted, 1_000_000), "name").select("row", "item_id").distinct()
    pairs = pairs.join(titles, "row").join(F.broadcast(asked) if holds_at_most(asked, 50_000, 64 << 20) else asked, "item_id")
    pairs = pairs.join(broadcast_if_small(mentioned, 50_000), "item_id")
    boost = fusion.title_boost(F.col("title"), F.col("query"), F.col("mentioned"), c_key=F.col("key"))
    return pairs.select("item_id", "doc_id", (boost > 0).alias("boosted")).where("boosted")


# --- evidence ------------------------------------------------------------------------

_EVIDENCE = HYBRID_SQL.format(min_score=0.4)


def _asked(spark, sf_dir):
    return benchmark_questions(spark, sf_dir).select("question_id", "question")


@query(
    _EVIDENCE + ", facts AS (SELECT question_id, max(score) AS top, bool_or(regexp_matches(c.content, '[0-9]')) AS num, bool_or(lower(c.section) IN ('src1', 'src2')) AS lead,"
    " bool_or(list_contains(c.tags, 'fr') OR contains(c.title || ' ' || c.section || ' ' || c.content, 'tion')) AS topic FROM evidence e JOIN corpus c USING (chunk_id) GROUP BY 1),"
    " g AS (SELECT question_id, coalesce(top >= 0.5, false) AS score_ok, NOT regexp_matches(question, '(?i)th') OR coalesce(num, false) AS numeric_ok,"
    " NOT regexp_matches(question, 'ing') OR coalesce(lead, false) AS lead_ok, NOT contains(question, 'tion') OR coalesce(topic, false) AS topic_ok"
    " FROM questions LEFT JOIN facts USING (question_id))"
    " SELECT *, score_ok AND numeric_ok AND lead_ok AND topic_ok AS sufficient FROM g"
)
def evidence_gates(spark, sf_dir):
    evidence, _ = general_evidence(spark, sf_dir)
    return ev.evidence_gates(
        _asked(spark, sf_dir), evidence, min_score=0.5, numeric_pattern="(?i)th", lead_pattern="ing",
        lead_sections=("src1", "src2"), topic_word="tion", topic_tag="fr",
    )


@query(
    _EVIDENCE + " SELECT question_id, rank, chunk_id, coalesce(slug, '') AS project_slug FROM evidence JOIN corpus USING (chunk_id)"
    " LEFT JOIN (SELECT p_partkey AS project_id, 'part' || p_partkey AS slug FROM part) USING (project_id)"
)
def evidence_slugs(spark, sf_dir):
    """Retrieved chunks with the slug of the entity they belong to."""
    evidence, _ = general_evidence(spark, sf_dir)
    slugs = load(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("entity_id"), F.concat(F.lit("part"), F.col("p_partkey").cast("string")).alias("slug")
    )
    return fusion.attach_slug(evidence, slugs).select(
        "question_id", "rank", "chunk_id", F.coalesce("project_slug", F.lit("")).alias("project_slug")
    )


@query(
    _EVIDENCE + ", facts AS (SELECT question_id, bool_or(lower(CASE WHEN e.chunk_id % 2 = 0 THEN 'main > ' || c.section ELSE c.section END) IN ('src1', 'src2')) AS whole,"
    " bool_or(lower(c.section) IN ('src1', 'src2')) AS last FROM evidence e JOIN corpus c USING (chunk_id) GROUP BY 1)"
    " SELECT question_id, NOT regexp_matches(question, 'ing') OR coalesce(whole, false) AS whole_ok, NOT regexp_matches(question, 'ing') OR coalesce(last, false) AS last_ok"
    " FROM questions LEFT JOIN facts USING (question_id)"
)
def evidence_gates_nested(spark, sf_dir):
    """The lead gate on nested section names, compared as a whole and by their last part."""
    evidence, _ = general_evidence(spark, sf_dir)
    nested = F.when(F.col("chunk_id") % 2 == 0, F.concat(F.lit("main > "), "section")).otherwise(F.col("section"))
    evidence = evidence.withColumn("section", nested)
    gate = lambda last: ev.evidence_gates(
        _asked(spark, sf_dir), evidence, lead_pattern="ing", lead_sections=("src1", "src2"), match_last_segment=last
    ).select("question_id", F.col("lead_ok").alias("last_ok" if last else "whole_ok"))
    return gate(False).join(gate(True), "question_id")


# Look-around is missing in the oracle's regular expressions: the next character is kept by a group.
_REF = r"(?i)(?:[\p{L}\p{N}_.-]+[\\/])+[\p{L}\p{N}_.-]*|[\p{L}\p{N}_.-]+\.[a-z][a-z0-9_-]{0,11}([^a-z0-9]|$)".replace("{", "{{").replace("}", "}}")


_SECRET = fixed.SECRET_PATTERN.replace("'", "''")


@query(
    ("SELECT doc_id, regexp_replace(split_part(text, chr(10), 1), '" + _REF + "', '[内部资料]\\1', 'g') AS title,"
     " regexp_replace(substr(regexp_replace(text, '" + _SECRET + "', '[REDACTED]', 'g'), 1, 150), '" + _REF + "', '[内部资料]\\1', 'g') AS content_preview"
     " FROM documents").replace("{{", "{").replace("}}", "}")
)
def citations(spark, sf_dir):
    evidence = load(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("question_id"), F.lit(1).alias("rank"), F.col("doc_id").alias("chunk_id"),
        F.substring_index("text", "\n", 1).alias("title"), F.col("source").alias("section"), F.col("text").alias("content"),
        F.array("lang").alias("tags"), F.lit(1.0).alias("score"),
    )
    return ev.format_citations(evidence).select(F.col("id").alias("doc_id"), "title", "content_preview")


@query(f"SELECT doc_id, md5(regexp_replace(text, '{_SECRET}', '[REDACTED]', 'g')) AS clean_md5, regexp_matches(text, '{_SECRET}') AS sensitive FROM documents")
def redact_sensitive(spark, sf_dir):
    return load(spark, sf_dir, "documents").select(
        "doc_id", F.md5(sf.redact_sensitive(F.col("text"))).alias("clean_md5"), sf.is_sensitive(F.col("text")).alias("sensitive")
    )


_FILE = r"(?i)(?:[\p{L}\p{N}_.-]+[\\/])+[\p{L}\p{N}_.-]+|[\p{L}\p{N}_.-]+\.[a-z][a-z0-9_-]{0,11}([^a-z0-9]|$)"
_re2 = lambda p: p.replace(r"一", r"\x{4e00}").replace(r"鿿", r"\x{9fff}")
_SAFETY = (
    "SELECT {id}, CASE WHEN " + " OR ".join(f"regexp_matches(q, '(?i){p}')" for p in fixed.UNSAFE_PATTERNS)
    + f" THEN 'direct' WHEN NOT regexp_matches(q, '{fixed.EXTRACTION_PATTERN}') THEN 'safe' WHEN regexp_matches(q, '(?i){fixed.PROTECTED_PATTERN}') THEN 'protected'"
    + f" WHEN regexp_matches(q, '{_FILE}') THEN 'file' WHEN regexp_matches(q, '{fixed.FILE_WORD_PATTERN}') THEN 'file_word' ELSE 'safe' END AS verdict"
).replace("{0,", "{{0,").replace(",11}", ",11}}").replace(",12}", ",12}}").replace(",8}", ",8}}").replace(",20}", ",20}}").replace(",10}", ",10}}").replace("p{L}", "p{{L}}").replace("p{N}", "p{{N}}")
# Every second document is asked to be shown, so that all rules take part.
_ASK = "CASE doc_id % 4 WHEN 0 THEN '展示' || text WHEN 1 THEN text || ' 打开文件' WHEN 2 THEN '查看 notes.md ' ELSE text || ' 私钥' END"


@query(_SAFETY.format(id="doc_id") + f" FROM (SELECT doc_id, regexp_replace(lower({_ASK}), '\\s+', '', 'g') AS q FROM documents)")
def classify_safety(spark, sf_dir):
    n = F.col("doc_id") % 4
    asked = (
        F.when(n == 0, F.concat(F.lit("展示"), "text")).when(n == 1, F.concat("text", F.lit(" 打开文件")))
        .when(n == 2, "查看 notes.md ").otherwise(F.concat("text", F.lit(" 私钥")))
    )
    return load(spark, sf_dir, "documents").select("doc_id", sf.classify_safety(asked).alias("verdict"))


@query(
    "SELECT conv_id, turn, CASE WHEN s AND w THEN 'both' WHEN s THEN 'strength' WHEN w THEN 'weakness' WHEN f THEN 'fit' ELSE 'default' END AS scope FROM ("
    "SELECT *, contains(lower(text), 'tion') AS s, contains(lower(text), 'ment') OR contains(lower(text), 'ble') AS w, contains(lower(text), 'heit') AS f FROM conversations)"
)
def answer_scope(spark, sf_dir):
    scope = sf.answer_scope(F.col("text"), "tion", "ment|ble", "heit")
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", scope.alias("scope"))


@query(
    "SELECT conv_id, turn, CASE WHEN contains(lower(text), 'keit') OR contains(lower(text), 'heit') THEN 'a|b' WHEN contains(lower(text), 'tion') THEN 'c' ELSE 'd|e' END AS suggestions FROM conversations"
)
def followups(spark, sf_dir):
    rules = ((("keit", "heit"), ("a", "b")), (("tion",), ("c",)))
    chosen = ev.suggest_followups(F.col("text"), rules, ("d", "e"))
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(chosen, "|").alias("suggestions"))


@query(
    CASCADE_SQL + ", expected AS (SELECT question_id, list_sort(list_distinct(list(coverage_key))) AS ks FROM targets GROUP BY 1),"
    " covered AS (SELECT question_id, list_distinct(flatten(list(string_split(coverage_keys, '|')))) AS cs FROM evidence GROUP BY 1),"
    " m AS (SELECT question_id, ks, list_filter(ks, lambda k: list_contains(coalesce(cs, []), k)) AS has, list_filter(ks, lambda k: NOT list_contains(coalesce(cs, []), k)) AS miss"
    " FROM expected LEFT JOIN covered USING (question_id)),"
    f" body AS (SELECT question_id, string_agg('[' || rank || '] ' || c.title || '（' || c.section || '）' || chr(10) || regexp_replace(c.content, '{_SECRET}', '[REDACTED]', 'g'), chr(10) || chr(10) ORDER BY rank) AS b"
    " FROM evidence JOIN corpus c USING (chunk_id) GROUP BY 1)"
    " SELECT question_id, md5('<knowledge_data>' || chr(10) || coalesce(b, '') || chr(10) || '</knowledge_data>') AS context_md5,"
    " 'asked ' || array_to_string(ks, '、') || '; found ' || CASE WHEN len(has) > 0 THEN array_to_string(has, '、') ELSE 'none' END"
    " || '; lacking ' || CASE WHEN len(miss) > 0 THEN array_to_string(miss, '、') ELSE 'none' END AS coverage_line FROM m LEFT JOIN body USING (question_id)"
)
def build_context(spark, sf_dir):
    plan, evidence, missing = cascade_evidence(spark, sf_dir)
    return ev.build_context(
        plan, evidence, missing, coverage_template="asked {expected}; found {covered}; lacking {missing}", none_text="none"
    ).select(
        "question_id", F.md5("context").alias("context_md5"), "coverage_line"
    )


_TEMPLATE = "Not enough is known. Known so far: {available_info}"


@query(
    _EVIDENCE.replace("s >= 0.4", "s >= 0.5") + f" SELECT question_id, replace('{_TEMPLATE}', '{{available_info}}', coalesce(substr(content, 1, 80), '暂无相关信息。')) AS fallback"
    " FROM questions LEFT JOIN (SELECT question_id, content FROM evidence JOIN corpus USING (chunk_id) WHERE rank = 1) USING (question_id)"
)
def fallback_text(spark, sf_dir):
    evidence, _ = general_evidence(spark, sf_dir, min_score=0.5)
    return ev.fallback_text(_asked(spark, sf_dir), evidence, _TEMPLATE)


@query("SELECT page_id, CASE WHEN regexp_matches(trim(url), '(?i)^https?://[^/?#]') THEN trim(url) ELSE '' END AS url FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN ' ' || url || ' ' WHEN 1 THEN replace(url, 'http', 'ftp') ELSE url END AS url FROM pages)")
def safe_url(spark, sf_dir):
    n = F.col("page_id") % 3
    given = F.when(n == 0, F.concat(F.lit(" "), "url", F.lit(" "))).when(n == 1, F.replace("url", F.lit("http"), F.lit("ftp"))).otherwise(F.col("url"))
    return load(spark, sf_dir, "pages").select("page_id", F.coalesce(sf.safe_url(given), F.lit("")).alias("url"))


@query()
def sanitize_pages(spark, sf_dir):
    return html.sanitize_pages(load(spark, sf_dir, "pages")).select("page_id", F.md5("clean").alias("clean_md5"), F.length("clean").alias("n"))


@query(
    "SELECT doc_id, coalesce(list_sum(list_transform(list_filter(regexp_split_to_array(text, '\\s+'), lambda p: p <> ''), lambda p: greatest(1, (length(p) + 3) // 4))), 0)::BIGINT AS tokens_ws,"
    " coalesce(list_sum(list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}\\p{M}_]+|[^\\p{L}\\p{N}\\p{M}_\\s]'), lambda p: (length(p) + 3) // 4)), 0)::BIGINT AS tokens_word FROM documents"
)
def token_estimates(spark, sf_dir):
    text = F.col("text")
    return load(spark, sf_dir, "documents").select(
        "doc_id", tx.estimate_tokens_ws(text).alias("tokens_ws"), tx.estimate_tokens_word(text).alias("tokens_word")
    )


_MARKED = "CASE conv_id % 3 WHEN 0 THEN text WHEN 1 THEN regexp_replace(text, '[a-m]', '?', 'g') ELSE '  ' END"


@query(
    f"SELECT conv_id, turn, CASE WHEN s = '' THEN '{fixed.BLANK_NOTICE}' WHEN len(regexp_extract_all(s, '\\?')) >= 5 AND len(regexp_extract_all(s, '\\?')) / length(s) >= 0.3 THEN '{fixed.DAMAGED_NOTICE}' ELSE s END AS shown"
    f" FROM (SELECT conv_id, turn, regexp_replace({_MARKED}, '^\\s+|\\s+$', '', 'g') AS s FROM conversations)"
)
def display_text(spark, sf_dir):
    n = F.col("conv_id") % 3
    given = F.when(n == 0, F.col("text")).when(n == 1, F.regexp_replace("text", "[a-m]", "?")).otherwise("  ")
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", tx.display_text(given).alias("shown"))


# --- FAQ -----------------------------------------------------------------------------


def faq_files(spark, sf_dir):
    """Documents in groups of ten, one file per group; the first sentence is the heading."""
    section = F.concat(F.lit("## "), F.regexp_extract("text", r"\A([^\n]*?)\.", 1), F.lit("?\n\n"), "text", F.lit("\n"))
    return (
        load(spark, sf_dir, "documents")
        .groupBy(F.concat(F.lit("faq/"), F.lpad(F.floor(F.col("doc_id") / 10).cast("string"), 9, "0")).alias("source_id"))
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", section.alias("t")))), lambda s: s["t"]), "").alias("text"))
    )


def pinned(spark, sf_dir):
    """First sentences that also open another document, and of every document with a label."""
    titles = load(spark, sf_dir, "documents").select("doc_id", F.regexp_extract("text", r"\A([^\n]*?)\.", 1).alias("title"))
    return titles.join(load(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").select("title")


_FAQ = """WITH sec AS (
  SELECT doc_id, regexp_extract(text, '^([^\\n]*?)\\.', 1) || '?' AS h, text FROM documents
), norm AS (
  SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(h, '^\\s+|\\s+$', '', 'g'), '[？?。.\\s]+$', ''), '\\s+', ' ', 'g') AS title,
         regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS answer FROM sec
), pin AS (
  SELECT DISTINCT title FROM norm JOIN labels USING (doc_id)
), faq AS (
  SELECT title, min(doc_id) AS pos, arg_max(answer, doc_id) AS answer FROM norm WHERE answer <> '' AND title IN (SELECT title FROM pin) GROUP BY 1
)"""


@query(_FAQ + " SELECT title, md5(answer) AS answer_md5 FROM faq")
def load_faq(spark, sf_dir):
    return faq.load_faq(faq_files(spark, sf_dir), pinned(spark, sf_dir)).select("title", F.md5("answer").alias("answer_md5"))


_COMPACT = "lower(regexp_replace({0}, '[^\\p{{L}}\\p{{N}}]+', '', 'g'))"


@query(
    _FAQ + f", q AS (SELECT item_id, text, regexp_replace(regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '[？?。.\\s]+$', ''), '\\s+', ' ', 'g') AS n FROM benchmark"
    f" UNION ALL SELECT 1000000 + doc_id, text, regexp_replace(regexp_replace(regexp_replace(split_part(text, '.', 1), '^\\s+|\\s+$', '', 'g'), '[？?。.\\s]+$', ''), '\\s+', ' ', 'g') FROM documents),"
    f" c AS (SELECT item_id, n, {_COMPACT.format('n')} AS c FROM q), t AS (SELECT *, {_COMPACT.format('title')} AS tc FROM faq),"
    " hits AS (SELECT item_id, title, CASE WHEN n = title THEN 0 ELSE 1 END AS cls, pos FROM c, t"
    " WHERE n = title OR c = tc OR (least(length(c), length(tc)) >= 10 AND (contains(c, tc) OR contains(tc, c))))"
    " SELECT item_id AS question_id, arg_min(title, cls * 1000000000 + pos) AS faq_title FROM hits GROUP BY 1"
)
def match_faq(spark, sf_dir):
    """Benchmark passages, and the first sentence of every document, as questions."""
    known = faq.load_faq(faq_files(spark, sf_dir), pinned(spark, sf_dir))
    asked = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question")).unionByName(
        load(spark, sf_dir, "documents").select(
            (F.col("doc_id") + 1000000).alias("question_id"), F.substring_index("text", ".", 1).alias("question")
        )
    )
    return faq.match_faq(asked, known).select("question_id", "faq_title")


@query("SELECT conv_id, turn, lower(regexp_replace(regexp_replace(split_part(text, ' ', 1), '[？?。.\\s]+$', ''), '[^\\p{L}\\p{N}]+', '', 'g')) IN ('the', 'en', 'in') AS greeting FROM conversations")
def is_greeting(spark, sf_dir):
    first = F.substring_index("text", " ", 1)
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", sf.is_greeting(first, ("the", "en", "in")).alias("greeting"))


@query()
def route_answers(spark, sf_dir):
    """Which way each question is answered: the whole chain over benchmark questions."""
    evidence, missing = general_evidence(spark, sf_dir)
    asked = _asked(spark, sf_dir)
    known = faq.load_faq(faq_files(spark, sf_dir), pinned(spark, sf_dir))
    plan = asked.select(
        "question_id", "question", F.lit("general").alias("intent"), F.array().cast("array<string>").alias("expected_coverage"),
        F.lit(5).alias("context_limit"),
    )
    return plan_answers(plan, evidence, missing, known).select("question_id", "route", F.md5(F.coalesce("answer", F.lit(""))).alias("answer_md5"))
