"""Vector and lexical candidates for a table of retrieval targets.

A target row holds ``target_id, query, embedding, fetch_k`` and, optionally,
``project_id`` (only chunks of that entity) and ``section_terms`` (only chunks
whose section contains one of them).
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from evidentia import fixed_values as fixed
from evidentia.functions.text import lexical_terms, like_literal
from evidentia.operators.block_topk import topk_by_block
from evidentia.operators.skew import salted_join
from evidentia.session import broadcast_if_small, cut_lineage

# Relaxation passes: both filters, without the section filter, without the entity filter.
PASSES = (1, 2, 3)


def filter_chunks(
    chunks: DataFrame,
    visibility: str = "public",
    confidence: Sequence[str] | None = fixed.TRUSTED_CONFIDENCE,
    project_ids: Sequence | None = None,
    section_terms: Sequence[str] | None = None,
) -> DataFrame:
    """Static corpus predicate; reaches the Parquet scan as pushed filters."""
    kept = chunks.where(F.col("visibility") == visibility)
    if confidence:
        kept = kept.where(F.col("confidence").isin(*confidence))
    if project_ids:
        kept = kept.where(F.col("project_id").isin(*project_ids))
    if section_terms:
        hit = F.lit(False)
        for term in section_terms:
            hit = hit | F.coalesce(F.col("section"), F.lit("")).ilike(f"%{term}%")
        kept = kept.where(hit)
    return kept


def vector_topk(
    targets: DataFrame, chunks: DataFrame, max_k: int, passes: tuple[int, ...] = (1,), **tuning
) -> DataFrame:
    """Exact nearest chunks by cosine: ``target_id, pass_no, chunk_id, similarity, rank``."""
    corpus = chunks.where(F.col("embedding").isNotNull()).select(
        "chunk_id",
        *_filter_columns(chunks),
        F.col("embedding").cast("array<float>").alias("embedding"),
    )
    asked = targets.where(F.col("embedding").isNotNull()).select(
        "target_id",
        "fetch_k",
        *_filter_columns(targets),
        F.col("embedding").cast("array<float>").alias("embedding"),
    )
    return topk_by_block(
        corpus, asked, _cosine, max_k=max_k, score_name="similarity",
        mask=_allowed, passes=passes, **tuning,
    )


def question_terms(targets: DataFrame, stop: Sequence[str] = fixed.LEXICAL_STOP_TERMS) -> DataFrame:
    return targets.withColumn("terms", lexical_terms(F.col("query"), stop))


#: A list is heavy for a target when it is longer than so many times the target's shorter lists together.
_HEAVY = 4
#: Heavy lists wait when they are longer than so many times all light ones; else one join of all lists is cheaper.
_WORTH_WAITING = 8
#: Entries of lists, each beside a target, that a task adds up.
_PAIRS_PER_TASK = 1_000_000


def lexical_topk(
    targets: DataFrame, chunks: DataFrame, max_k: int, passes: tuple[int, ...] = (1,),
    stop: Sequence[str] = fixed.LEXICAL_STOP_TERMS, terms_per_scan: int = 100_000,
) -> DataFrame:
    """Best chunks by weighted term hits: ``target_id, pass_no, chunk_id, raw_score, lexical_score, rank``.

    ``lexical_score`` is the share of the highest score the target's terms allow. The terms' lists of chunks meet
    the targets by an equi-join, and partial sums give the scores, so only chunks that share a term with a
    target ever meet it. Heavy lists wait: where the ``fetch_k``-th best sum of the others is more than all heavy
    terms could add, no new chunk can get in, and only the chunks that could still rank look up what the heavy
    terms add to them. The result is exact.
    """
    asked = cut_lineage(question_terms(targets, stop).where(F.size("terms") > 0).select(
        "target_id", "fetch_k", "terms", *_filter_columns(targets)
    ))
    wanted = asked.withColumn("term", F.explode("terms")).drop("terms")
    # Lists carry what the targets filter by and no more: sums without texts need no sorting of all entries.
    carried = [c for c, by in (("project_id", "project_id"), ("section", "section_terms")) if by in targets.columns and c in chunks.columns]
    lists = cut_lineage(term_lists(chunks, wanted.select("term").distinct(), terms_per_scan, carried))
    lengths = lists.groupBy("term").agg(F.count("*").alias("length"), F.max("weight").alias("most"))
    order = W.partitionBy("target_id").orderBy("length", "term")
    shorter = F.coalesce(F.sum("length").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    heavy = F.col("length") > _HEAVY * F.greatest(shorter, F.col("fetch_k").cast("long"))
    wanted = cut_lineage(
        wanted.join(lengths, "term").withColumn("heavy", heavy).withColumn("heavy", F.max("heavy").over(order))
    )
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("length"))), F.lit(0))
    size = wanted.agg(total(F.col("heavy")).alias("heavy"), total(~F.col("heavy")).alias("light"), F.count("*").alias("rows")).first()
    few = size.rows <= 1_000_000
    if few:
        # All entries of a chunk meet in one task, which adds them up for a bounded number of pairs with targets.
        parts = max(lists.sparkSession.sparkContext.defaultParallelism, -(-(size.heavy + size.light) // _PAIRS_PER_TASK))
        lists = lists.repartition(parts, "chunk_id")
    if size.heavy > _WORTH_WAITING * size.light:
        sums = _with_late(cut_lineage(_sums(_met(lists, wanted.where("not heavy"), few))), lists, wanted.where("heavy"), asked, passes, few)
    else:
        sums = _sums(_met(lists, wanted, few))
    best = W.partitionBy("target_id", "pass_no").orderBy(F.desc("raw_score"), "chunk_id")
    ranked = (
        _passes(sums, asked, passes).withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= max_k).where(F.col("rank") <= F.col("fetch_k"))
    )
    return ranked.select(
        "target_id", "pass_no", "chunk_id", "raw_score", lexical_score(F.col("raw_score"), F.col("terms")).alias("lexical_score"), "rank"
    )


def _met(lists: DataFrame, wanted: DataFrame, few: bool) -> DataFrame:
    """Every entry of a list beside each target that wants its term; ``few``: the targets' terms may be broadcast."""
    narrow = wanted.select("target_id", "term")
    if few:
        return lists.join(F.broadcast(narrow), "term")
    return salted_join(lists, narrow, ["term"], ["chunk_id"])


def _sums(met: DataFrame) -> DataFrame:
    carried = [F.first(c).alias(c) for c in ("project_id", "section") if c in met.columns]
    return met.groupBy("target_id", "chunk_id").agg(F.sum("weight").alias("raw_score"), *carried)


def _with_late(
    sums: DataFrame, lists: DataFrame, late: DataFrame, asked: DataFrame, passes: tuple[int, ...], few: bool
) -> DataFrame:
    """Sums of the light lists, completed by the heavy ones as far as these can matter."""
    bounds = late.groupBy("target_id").agg(F.sum("most").alias("bound"))
    scored = _passes(sums, asked.join(bounds, "target_id"), passes)
    place = W.partitionBy("target_id", "pass_no").orderBy(F.desc("raw_score"), "chunk_id")
    floors = scored.withColumn("at", F.row_number().over(place)).where(F.col("at") <= F.col("fetch_k")).where(F.col("at") == F.col("fetch_k"))
    # A target is closed when all its passes are; ties go to smaller ids, so the floor must be above the bound.
    closed_passes = floors.where(F.col("raw_score") > F.col("bound")).select("target_id", "pass_no", F.col("raw_score").alias("floor"))
    due = _applicable(asked, passes).select("target_id", F.size("pass_nos").alias("due"))
    closed = cut_lineage(
        closed_passes.groupBy("target_id").agg(F.count("*").alias("n"), F.min("floor").alias("floor")).join(due, "target_id")
        .where("n = due").join(bounds, "target_id").select("target_id", (F.col("floor") - F.col("bound")).alias("least"))
    )
    kept = sums.join(broadcast_if_small(closed, 1_000_000), "target_id", "left").where(
        F.col("least").isNull() | (F.col("raw_score") >= F.col("least"))
    )
    still = late.join(closed, "target_id", "left_anti")
    chosen = kept.where(F.col("least").isNotNull()).select("target_id", "chunk_id").join(late.select("target_id", "term"), "target_id")
    heavy = broadcast_if_small(late.select("term").distinct(), 1_000_000)
    added = lists.join(heavy, "term", "left_semi").join(chosen, ["chunk_id", "term"])
    columns = ["target_id", "chunk_id", "weight", *(c for c in ("project_id", "section") if c in lists.columns)]
    parts = kept.withColumnRenamed("raw_score", "weight").select(columns)
    return _sums(parts.unionByName(_met(lists, still, few).select(columns)).unionByName(added.select(columns)))


def _applicable(asked: DataFrame, passes: tuple[int, ...]) -> DataFrame:
    """``pass_nos``: the passes that a target has."""
    has = {2: _sections(asked) > 0, 3: _entity(asked).isNotNull()}
    numbers = [F.when(has[n], F.lit(n)) if n in has else F.lit(n) for n in passes]
    return asked.withColumn("pass_nos", F.array_compact(F.array(*numbers)))


def _sections(asked: DataFrame) -> Column:
    return F.coalesce(F.size("section_terms"), F.lit(0)) if "section_terms" in asked.columns else F.lit(0)


def _entity(asked: DataFrame) -> Column:
    return F.col("project_id") if "project_id" in asked.columns else F.lit(None)


def _passes(sums: DataFrame, asked: DataFrame, passes: tuple[int, ...]) -> DataFrame:
    """One row for each pass of the target that allows the chunk."""
    filters = {c: f"_{c}" for c in ("project_id", "section_terms") if c in asked.columns}
    known = _applicable(asked, passes)
    for name, kept in filters.items():
        known = known.withColumnRenamed(name, kept)
    rows = sums.join(broadcast_if_small(known), "target_id").withColumn("pass_no", F.explode("pass_nos")).drop("pass_nos")
    if "project_id" in filters:
        rows = rows.where((F.col("pass_no") == 3) | F.col("_project_id").isNull() | F.coalesce(F.col("project_id") == F.col("_project_id"), F.lit(False)))
    if "section_terms" in filters:
        within = F.exists("_section_terms", lambda t: F.ilike(F.coalesce(F.col("section"), F.lit("")), like_literal(t)))
        rows = rows.where((F.col("pass_no") == 2) | (F.coalesce(F.size("_section_terms"), F.lit(0)) <= 0) | within)
    return rows


def term_lists(chunks: DataFrame, terms: DataFrame, terms_per_scan: int = 100_000, carried: Sequence[str] = ()) -> DataFrame:
    """The inverted lists of ``terms``: ``term, chunk_id, weight`` (and ``carried`` columns) for every chunk that holds the term.

    A scan looks for a bounded slice of terms at once, by one pass over each whole field with an automaton of the
    slice. Terms match inside words; ``_`` matches any character: such a term is looked up by its
    longest literal part and verified. ``weight`` adds up the weights of the fields with the term.
    """
    first = [r.term for r in terms.select("term").limit(terms_per_scan + 1).collect()]
    if len(first) <= terms_per_scan:
        return _scan(chunks, first, carried)
    slices = -(-terms.count() // terms_per_scan)
    number = F.pmod(F.xxhash64("term"), F.lit(slices))
    parts = [_scan(chunks, [r.term for r in terms.where(number == k).select("term").collect()], carried) for k in range(slices)]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union


def _scan(chunks: DataFrame, terms: list[str], carried: Sequence[str]) -> DataFrame:
    carried = ["chunk_id", *carried]
    weights = list(fixed.LEXICAL_WEIGHTS.values())
    fields = [F.lower(F.coalesce(F.col(name), F.lit(""))).alias(f"field{n}") for n, name in enumerate(fixed.LEXICAL_WEIGHTS)]
    shared = chunks.sparkSession.sparkContext.broadcast(terms)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _Finder(shared.value)
        for batch in batches:
            rows, found, weight = [], [], []
            for row, texts in enumerate(zip(*(batch.column(f"field{n}").to_pylist() for n in range(len(weights))))):
                hits: dict[int, float] = {}
                for text, w in zip(texts, weights):
                    for term in finder.terms_in(text):
                        hits[term] = hits.get(term, 0.0) + w
                rows.extend([row] * len(hits))
                found.extend(hits)
                weight.extend(hits.values())
            at = pa.array(rows, type=pa.int64())
            names = pa.array(shared.value, type=pa.string()).take(pa.array(found, type=pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(at) for c in carried), names, pa.array(weight, type=pa.float64())], names=[*carried, "term", "weight"]
            )

    types = ", ".join(f"{c} {chunks.schema[c].dataType.simpleString()}" for c in carried)
    return chunks.select(*carried, *fields).mapInArrow(find, f"{types}, term string, weight double")


class _Finder:
    """Which of many terms occur in a text."""

    def __init__(self, terms: list[str]):
        self.whole, self.wild = ahocorasick.Automaton(), {}
        of_part: dict[str, list[int]] = {}
        for number, term in enumerate(terms):
            literal = max(term.split("_"), key=len)
            of_part.setdefault(literal, []).append(number)
            if literal != term:
                self.wild[number] = re.compile(".".join(map(re.escape, term.split("_"))), re.S)
        self.always = of_part.pop("", [])
        for literal, numbers in of_part.items():
            self.whole.add_word(literal, numbers)
        self.whole.make_automaton()
        self.empty = not of_part
        self.known: dict[str, list[int]] = {}

    def terms_in(self, text: str) -> list[int]:
        """Numbers of the terms; answers for short texts, which repeat often, are kept."""
        if len(text) > 64:
            return self._search(text)
        if text not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[text] = self._search(text)
        return self.known[text]

    def _search(self, text: str) -> list[int]:
        found = set(self.always)
        if not self.empty:
            for _, numbers in self.whole.iter(text):
                found.update(numbers)
        return [n for n in found if n not in self.wild or self.wild[n].search(text)]


def lexical_score(c_raw: Column, c_terms: Column) -> Column:
    full = F.greatest(F.lit(1.0), F.size(c_terms) * sum(fixed.LEXICAL_WEIGHTS.values()))
    return F.least(F.lit(1.0), c_raw / full)


def _filter_columns(df: DataFrame) -> list[str]:
    return [c for c in ("project_id", "section", "section_terms") if c in df.columns]


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    flat = vectors.combine_chunks()
    rows = flat.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(len(flat), -1)
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    # A vector of length zero has no direction: NaN, so it never matches.
    return np.divide(rows, norms, out=np.full_like(rows, np.nan), where=norms > 0)


def _cosine(block: pa.Table, questions: pa.Table) -> np.ndarray:
    # Equal vectors score alike whatever their place in a block.
    return np.round(_matrix(block.column("embedding")) @ _matrix(questions.column("embedding")).T, 12)


def _allowed(block: pa.Table, questions: pa.Table, pass_no: int) -> np.ndarray | None:
    """Rows each question may use in this pass, or None if no question has the pass."""
    everything = np.ones((len(block), len(questions)), dtype=bool)
    by_entity = "project_id" in questions.column_names
    by_section = "section_terms" in questions.column_names
    wanted = questions.column("project_id").to_pylist() if by_entity else [None] * len(questions)
    sections = questions.column("section_terms").to_pylist() if by_section else [None] * len(questions)
    if pass_no == 2:
        applies = np.array([bool(s) for s in sections])
    elif pass_no == 3:
        applies = np.array([w is not None for w in wanted])
    else:
        applies = np.ones(len(questions), dtype=bool)
    if not applies.any():
        return None
    allowed = everything & applies
    if by_entity and pass_no != 3:
        owner = np.array(block.column("project_id").to_pylist(), dtype=object)[:, None]
        asked = np.array(wanted, dtype=object)[None, :]
        allowed &= np.equal(asked, None) | np.equal(owner, asked)
    if by_section and pass_no != 2:
        names = block.column("section").to_pylist()
        known: dict[tuple, np.ndarray] = {}
        for column, terms in enumerate(sections):
            if not terms:
                continue
            key = tuple(terms)
            if key not in known:
                verdicts = {n: _in_section(n, key) for n in set(names)}
                known[key] = np.array([verdicts[n] for n in names])
            allowed[:, column] &= known[key]
    return allowed


def _in_section(section: str | None, terms: tuple[str, ...]) -> bool:
    text = (section or "").lower()
    return any(re.search(_like_regex(t.lower()), text, re.S) for t in terms)


def _like_regex(term: str) -> str:
    return "".join({"_": ".", "%": ".*"}.get(ch, re.escape(ch)) for ch in term)
