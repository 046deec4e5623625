"""Secrets in texts: fixed patterns, and random-looking strings found by a battery of randomness tests.

Everything here is column expressions and joins; no Python runs on the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from evidentia.llm.common import keep, prepare, text_frame

#: The patterns of the kinds, in the order of listing.
ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # AKIA[A-Z0-9]+ of 20 characters or more
HEX = r"[0-9a-f]{24,}"  # [0-9a-f]+ of 24 characters or more
KINDS = ("assign", "access", "hex", "random")
LEAST_ASSIGNED = 6

#: Strings that the battery looks at: runs of 20 and more characters of the usual encodings.
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
#: Lengths at which a stratum of the false-discovery control begins.
STRATA = (20, 32, 64, 128)
FALSE_DISCOVERY = 0.01
#: A test of the battery fails beyond so many standard deviations from what random symbols give.
FAILS = 3.1
#: Of text: the chance that two letters are equal, and that neighbours differ in case or class.
TEXT_REPEAT, TEXT_CHANGE = 0.065, 0.08
_STEP = 0.01  # of the decimal logarithm, in the histogram of p-values

_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings from the narrowest to the widest: pattern and alphabet.
ENCODINGS = (
    (r"[0-9a-f]+", _DIGITS + "abcdef"),
    (r"[0-9A-F]+", _DIGITS + "ABCDEF"),
    (r"[A-Z2-7]+=*", _UPPER + "234567"),
    (r"[A-Z0-9]+", _UPPER + _DIGITS),
    (r"[a-z0-9]+", _LOWER + _DIGITS),
    (r"[A-Za-z0-9]+", _UPPER + _LOWER + _DIGITS),
    (r"[A-Za-z0-9_-]+=*", _UPPER + _LOWER + _DIGITS + "-_"),
    (r"[A-Za-z0-9+/_-]+=*", _UPPER + _LOWER + _DIGITS + "+/-_"),
)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, spans, base)``, one row per input row: arrays of ``(start, rank, end, kind)`` in order.

    ``base`` has the matches of the fixed patterns, leftmost and not overlapping within a kind:
    assignments whose value has 6 characters or more, access keys of 20, lower-case hex runs of 24. ``spans`` adds
    ``random``: strings outside base spans that pass the battery of ``random_strings``. Positions are code points, the end
    exclusive. Null and empty texts have none. Repeated rows have equal results; null ids are ids. An
    empty table gives no rows; other columns are not read.
    """
    prepare(docs.sparkSession)
    rows = text_frame(docs, id_col, text_col).withColumn("key", F.xxhash64("text"))
    suspects = rows.filter(F.col("text").rlike(CANDIDATE) | F.col("text").rlike(ASSIGN)).groupBy("doc_id", "key").agg(
        F.first("text").alias("text")
    )
    found = keep(_matches(suspects), "matches")
    base = found.filter(F.col("rank") < 3).select("doc_id", "key", "start", "rank", "end")
    random = random_strings(found.filter(F.col("rank") == 3)).select("doc_id", "key", "start", F.lit(3).alias("rank"), "end")
    spans = base.unionByName(random).groupBy(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).agg(
        F.array_sort(F.collect_list(F.struct("start", "rank", "end"))).alias("_all")
    )
    joined = rows.select("doc_id", "key").join(spans, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left")
    fixed = F.filter("_all", lambda x: x["rank"] < 3)
    inside = lambda r: F.exists("base", lambda b: (b["start"] <= r["start"]) & (r["end"] <= b["end"]))
    none = F.array().cast("array<struct<start: bigint, rank: int, end: bigint>>")
    return (
        joined.select("doc_id", F.coalesce("_all", none).alias("_all"), F.coalesce(fixed, none).alias("base"))
        .select("doc_id", F.filter("_all", lambda x: (x["rank"] < 3) | ~inside(x)).alias("spans"), "base")
    )


def listed(spans: str) -> Column:
    """``kind:start:end`` of each span, joined with commas."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["rank"]), x["start"], x["end"])), ",")


def count_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["rank"] == KINDS.index(kind))).cast("long")


def _matches(suspects: DataFrame) -> DataFrame:
    """``(doc_id, key, rank, start, end, value)`` of all matches, from the pieces of text between them."""

    def of(rank: int, pattern: str, group: int) -> Column:
        whole = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        value = F.regexp_extract_all("text", F.lit(pattern), F.lit(group))
        return F.transform(
            F.arrays_zip(F.slice(F.split("text", pattern, -1), F.lit(1), F.size(whole)).alias("gap"), whole.alias("match"), value.alias("value")),
            lambda x, i: F.struct(
                F.lit(rank).alias("rank"), i.alias("i"), F.char_length(x["gap"]).alias("gap"), F.char_length(x["match"]).alias("length"),
                (F.char_length(x["value"]) >= LEAST_ASSIGNED if rank == 0 else F.lit(True)).alias("counts"),
                (x["value"] if rank == 3 else F.lit(None).cast("string")).alias("value"),
            ),
        )

    kinds = F.concat(of(0, ASSIGN, 2), of(1, ACCESS, 0), of(2, HEX, 0), of(3, CANDIDATE, 0))
    each = suspects.select("doc_id", "key", F.explode(kinds).alias("m")).select("doc_id", "key", "m.*")
    upto = Window.partitionBy("doc_id", "key", "rank").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("length")).over(upto)
    return each.withColumn("end", end).filter("counts").select(
        "doc_id", "key", "rank", (F.col("end") - F.col("length")).alias("start"), "end", "value"
    )


def random_strings(candidates: DataFrame) -> DataFrame:
    """The rows of ``candidates`` whose ``value`` looks like a random string of its encoding.

    The encoding is the narrowest alphabet that holds all characters. Three tests ask for random
    symbols: chi-squared for uniform use of the alphabet, the number of runs of lower-case, upper-case, digits
    and signs, and the correlation of neighbouring symbols. A string that fails one is dropped. How
    unlikely text is to look so random is the p-value: uniformity and runs against
    what text of that length and alphabet gives, put together by Stouffer's rule. Longer strings can reach
    smaller p-values, so they are controlled apart: within each stratum of lengths, the Benjamini-Hochberg
    rule keeps the share of false discoveries at ``FALSE_DISCOVERY``.
    """
    scored = battery(candidates)
    strata = F.lit(0)
    for low in STRATA:
        strata = F.when(F.col("n") >= low, low).otherwise(strata)
    scored = scored.withColumn("stratum", strata).withColumn("grade", F.floor(-F.col("log_p") / _STEP).cast("int"))
    counts = scored.groupBy("stratum", "grade").agg(F.count(F.lit(1)).alias("c"))  # at most a few thousand grades
    better = Window.partitionBy("stratum").orderBy(F.desc("grade")).rowsBetween(Window.unboundedPreceding, 0)
    control = counts.withColumn("found", F.sum("c").over(better)).withColumn("all", F.sum("c").over(Window.partitionBy("stratum")))
    limit = control.filter(-F.col("grade") * _STEP <= F.log10(FALSE_DISCOVERY * F.col("found") / F.col("all"))).groupBy(
        F.col("stratum").alias("_stratum")
    ).agg(F.min("grade").alias("limit"))
    return scored.join(F.broadcast(limit), F.col("stratum") == F.col("_stratum")).filter("passes and grade >= limit")


def battery(candidates: DataFrame) -> DataFrame:
    """``candidates`` with ``n``, the z-scores ``z_uniform``, ``z_runs``, ``z_serial``, ``passes`` and ``log_p``."""
    alphabet = F.lit(None).cast("string")
    for pattern, symbols in reversed(ENCODINGS):
        alphabet = F.when(F.col("value").rlike(f"^{pattern}$"), symbols).otherwise(alphabet)
    body = F.regexp_replace("value", "=+$", "")
    rows = candidates.withColumn("body", body).withColumn("alphabet", alphabet).withColumn("n", F.char_length("body").cast("double"))
    rows = rows.withColumn("k", F.char_length("alphabet").cast("double"))

    squares = F.aggregate(
        F.array_distinct(F.split("body", "")), F.lit(0.0),
        lambda s, c: s + F.pow(F.col("n") - F.char_length(F.replace(F.col("body"), c, F.lit(""))), 2),
    )
    rows = rows.withColumn("chi", F.col("k") / F.col("n") * squares - F.col("n"))
    free = F.col("k") - 1
    bend = 2 / (9 * free)
    z_uniform = (F.pow(F.col("chi") / free, F.lit(1 / 3)) - (1 - bend)) / F.sqrt(bend)

    classes = F.col("body")
    for pattern, letter in (("[a-z]", "a"), ("[A-Z]", "A"), ("[0-9]", "0"), ("[^aA0]", "-")):
        classes = F.regexp_replace(classes, pattern, letter)
    rows = rows.withColumn("changes", F.char_length(F.regexp_replace(classes, r"(.)\1*", "x")) - 1.0)
    shares = [
        F.char_length(F.regexp_replace("alphabet", f"[^{span}]", "")) / F.col("k") for span in ("a-z", "A-Z", "0-9", "+/_-")
    ]
    rows = rows.withColumn("turn", 1 - sum(s * s for s in shares))
    pairs = F.col("n") - 1
    z_runs = (F.col("changes") - pairs * F.col("turn")) / F.sqrt(F.greatest(pairs * F.col("turn") * (1 - F.col("turn")), F.lit(1e-9)))

    rows = rows.withColumn("places", F.expr("transform(split(body, ''), c -> cast(instr(alphabet, c) as double))"))
    rows = rows.withColumn("mean", F.aggregate("places", F.lit(0.0), lambda s, x: s + x) / F.col("n"))
    spread = F.aggregate("places", F.lit(0.0), lambda s, x: s + F.pow(x - F.col("mean"), 2))
    serial = F.aggregate(
        F.zip_with(F.slice("places", F.lit(1), F.col("n").cast("int") - 1), F.slice("places", F.lit(2), F.col("n").cast("int") - 1),
                   lambda x, y: (x - F.col("mean")) * (y - F.col("mean"))),
        F.lit(0.0), lambda s, x: s + x,
    )
    z_serial = F.when(spread > 0, serial / spread * F.sqrt("n")).otherwise(F.sqrt("n"))

    skew = F.col("k") * TEXT_REPEAT - 1  # of text's letters over this alphabet; hex text is as skewed as 26 letters
    skew = F.greatest(skew, F.lit(26 * TEXT_REPEAT - 1))
    text_uniform = (F.col("chi") - free - (F.col("n") - 1) * skew) / F.sqrt(2 * free + 4 * F.col("n") * skew)
    text_runs = (pairs * TEXT_CHANGE - F.col("changes")) / F.sqrt(pairs * TEXT_CHANGE * (1 - TEXT_CHANGE))
    z = (text_uniform + text_runs) / F.sqrt(F.lit(2.0))
    # The normal distribution's lower tail by the logistic approximation, as a decimal logarithm.
    log_p = F.greatest(-F.log10(1 + F.exp(F.least(F.lit(60.0), -(1.5976 * z + 0.07056 * z * z * z)))), F.lit(-26.0))
    rows = rows.withColumns({"z_uniform": z_uniform, "z_runs": z_runs, "z_serial": z_serial, "log_p": log_p})
    passes = (F.col("z_uniform") <= FAILS) & (F.abs("z_runs") <= FAILS) & (F.abs("z_serial") <= FAILS)
    return rows.withColumn("passes", passes).drop("body", "alphabet", "k", "chi", "changes", "turn", "places", "mean")
