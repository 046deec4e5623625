"""Corpus validation: one row per finding (``source_id, level, rule, detail``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from evidentia import fixed_values as fixed
from evidentia.functions import markdown as md
from evidentia.operators.skew import salted_join
from evidentia.session import cut_lineage

_FINDING = "array<struct<level:string,rule:string,detail:string>>"


def _finding(when: Column, level: str, rule: str, detail: Column) -> Column:
    return F.when(when, F.struct(F.lit(level).alias("level"), F.lit(rule).alias("rule"), detail.alias("detail")))


def validate_corpus(
    files: DataFrame,
    required: Sequence[str] = fixed.REQUIRED_FIELDS,
    types: Sequence[str] = fixed.KNOWN_TYPES,
    visibility: Sequence[str] = fixed.KNOWN_VISIBILITY,
    confidence: Sequence[str] = fixed.KNOWN_CONFIDENCE,
) -> DataFrame:
    """Findings for ``files(source_id, text[, read_error])``.

    Texts are read in one scan, which evaluates all rules about a single file and
    keeps its findings and id. Only the check for repeated ids shuffles, and only
    ids and paths.
    """
    checked = _checked(files)
    meta = F.col("meta")
    value = lambda key: md.meta_value(meta, key)
    usable = (F.col("header_error") == "")
    header = _finding(~usable, "error", "header", F.col("header_error"))
    names = F.transform(meta, lambda e: e["key"])
    missing = F.transform(
        F.array_sort(F.filter(F.array(*[F.lit(r) for r in required]), lambda r: ~F.array_contains(names, r))),
        lambda r: F.struct(F.lit("error").alias("level"), F.lit("required").alias("rule"), r.alias("detail")),
    ).cast(_FINDING)
    entry_id = md.meta_entry(meta, "id")
    no_id = entry_id.isNull() | (F.size(entry_id["values"]) == 0)

    def outside(key: str, allowed: Sequence[str], level: str) -> Column:
        given = value(key)
        return _finding(given.isNotNull() & ~given.isin(*allowed), level, key, given)

    single = F.array_compact(
        F.array(
            _finding(no_id, "error", "id_empty", F.lit("")),
            outside("type", types, "warning"),
            outside("visibility", visibility, "error"),
            outside("confidence", confidence, "error"),
            _finding(~F.col("closed") | (F.col("body") == ""), "warning", "body_empty", F.lit("")),
        )
    ).cast(_FINDING)
    findings = F.when(usable, F.concat(missing, single)).otherwise(F.array_compact(F.array(header)).cast(_FINDING))
    judged = cut_lineage(
        checked.select("source_id", findings.alias("findings"), F.when(usable, value("id")).alias("id"))
    )
    per_file = judged.select("source_id", F.explode("findings").alias("f")).select("source_id", "f.*")
    return per_file.unionByName(repeated_ids(judged))


def _checked(files: DataFrame) -> DataFrame:
    readable = ~F.col("read_error") if "read_error" in files.columns else F.lit(True)
    text = F.coalesce("text", F.lit(""))
    return (
        files.select(
            "source_id", text.alias("text"), readable.alias("readable"), F.inline(F.array(md.split_front_matter(text)))
        )
        .withColumn("meta", md.parse_front_matter(F.col("header"), keep_empty=False))
        .select(
            "source_id", "meta", "body", F.col("header").isNotNull().alias("closed"),
            F.when(~F.col("readable"), "unreadable")
            .when(~F.startswith(F.col("text"), F.lit("---")), "missing")
            .when(F.size("meta") == 0, "empty")
            .otherwise("")
            .alias("header_error"),
        )
    )


def repeated_ids(files: DataFrame) -> DataFrame:
    """Every file (``source_id, id``) after the first, in path order, that uses an id again.

    Ids are counted with a pre-aggregation; only ids used more than once meet the
    files again, and a very frequent id is spread by salting.
    """
    ids = files.select("source_id", "id").where(F.col("id").isNotNull())
    first = (
        ids.groupBy("id").agg(F.min("source_id").alias("first_file"), F.count("*").alias("n")).where(F.col("n") > 1)
    )
    return (
        salted_join(ids, first, ["id"], ["source_id"])
        .where(F.col("source_id") != F.col("first_file"))
        .select(
            "source_id", F.lit("error").alias("level"), F.lit("id_repeated").alias("rule"),
            F.concat_ws(" ", "id", "first_file").alias("detail"),
        )
    )


def validation_report(findings: DataFrame) -> DataFrame:
    return findings.agg(
        F.count_if(F.col("level") == "error").alias("errors"),
        F.count_if(F.col("level") == "warning").alias("warnings"),
    ).withColumn("passed", F.col("errors") == 0)


def check_golden(golden: DataFrame) -> DataFrame:
    """Findings about ``golden(id, expected_sources)``: repeated ids, cases without a source."""
    repeated = golden.groupBy("id").count().where(F.col("count") > 1).select("id", F.lit("id_repeated").alias("rule"))
    bare = golden.where(F.coalesce(F.size("expected_sources"), F.lit(0)) <= 0).select("id", F.lit("no_source").alias("rule"))
    return repeated.unionByName(bare)
