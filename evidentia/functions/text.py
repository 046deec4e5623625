"""Column functions over text. All of them are built-in expressions (no Python workers)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from evidentia import fixed_values as fixed

CJK = r"\u4e00-\u9fff"


# Characters Unicode counts as white space, with the four separator controls.
WHITE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(chr(code) for code in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: Column) -> Column:
    """Remove white space of any kind from both ends; looks at the ends only."""
    return F.btrim(c, F.lit(WHITE))


def lines(c: Column) -> Column:
    """Split on every line break a text editor would honour."""
    return F.split(c, r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]")


def normalize_key(c: Column) -> Column:
    """Lower-case and keep only digits, Latin letters and CJK characters."""
    return F.regexp_replace(F.lower(c), rf"[^0-9a-z{CJK}]+", "")


def substrings(c: Column, width: int) -> Column:
    """Every substring of ``width`` characters, in order, with repeats; linear in the text."""
    return F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{width}}}))"), F.lit(1))


def cjk_bigrams(c: Column) -> Column:
    """Distinct neighbouring pairs among the CJK characters of ``c``, other characters removed first."""
    pairs = F.array_distinct(substrings(F.regexp_replace(c, rf"[^{CJK}]", ""), 2))
    # Most texts hold none; a look for the first character is much cheaper than taking all others away.
    return F.when(c.isNull() | F.rlike(c, F.lit(rf"[{CJK}]")), pairs).otherwise(F.array().cast("array<string>"))


def lexical_terms(
    c: Column, stop: Sequence[str] = fixed.LEXICAL_STOP_TERMS, limit: int = 12
) -> Column:
    """Search terms of a question: Latin words and CJK pairs, longest first."""
    latin = F.regexp_extract_all(F.lower(c), F.lit(r"[a-z][a-z0-9_-]{1,}"), F.lit(0))
    kept = F.array_except(
        F.array_union(latin, cjk_bigrams(c)), F.array(*[F.lit(s) for s in stop])
    )
    by_length = F.array_sort(
        F.transform(kept, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("term")))
    )
    return F.slice(F.transform(by_length, lambda s: s["term"]), 1, limit)


def searchable_tokens(c: Column) -> Column:
    """The distinct units inside which a search term can occur.

    A Latin term holds only ``[a-z0-9_-]``, so an occurrence never crosses the
    border of a maximal run of these; a CJK term is one neighbouring pair.
    """
    text = F.lower(F.coalesce(c, F.lit("")))
    return F.array_distinct(
        F.concat(
            F.regexp_extract_all(text, F.lit(r"[a-z0-9_-]+"), F.lit(0)),
            F.regexp_extract_all(text, F.lit(rf"(?=([{CJK}]{{2}}))"), F.lit(1)),
        )
    )


def contains_any(c: Column, words: Sequence[str]) -> Column:
    """True if one of a fixed word list occurs in ``c``."""
    found = F.lit(False)
    for word in words:
        found = found | F.contains(c, F.lit(word))
    return found


def like_literal(c: Column) -> Column:
    """``%term%`` pattern; ``_`` and ``%`` inside the term stay wildcards."""
    return F.concat(F.lit("%"), c, F.lit("%"))


_WIDE = r"[\u3400-\u9fff]"


def estimate_tokens_ws(c: Column) -> Column:
    """Token estimate over white-space separated parts (conversation budget)."""
    return _estimate(c, lambda rest: F.filter(F.split(rest, r"(?U)\s+"), lambda p: p != ""))


def estimate_tokens_word(c: Column) -> Column:
    """Token estimate over words and single punctuation marks (answer log)."""
    return _estimate(
        c, lambda rest: F.regexp_extract_all(rest, F.lit(r"(?U)\w+|[^\w\s]"), F.lit(0))
    )


def _estimate(c: Column, parts_of) -> Column:
    wide = F.regexp_count(c, F.lit(_WIDE))
    parts = parts_of(F.regexp_replace(c, _WIDE, " "))
    units = F.aggregate(
        parts,
        F.lit(0).cast("long"),
        lambda total, p: total + F.greatest(F.lit(1), F.ceil(F.length(p) / 4)).cast("long"),
    )
    return (wide + units).cast("long")


def display_text(c: Column) -> Column:
    """Replace blank text and text damaged by a wrong encoding with a notice."""
    shown = strip(F.coalesce(c, F.lit("")))
    marks = F.regexp_count(shown, F.lit(r"\?"))
    return (
        F.when(shown == "", F.lit(fixed.BLANK_NOTICE))
        .when((marks >= 5) & (marks / F.length(shown) >= 0.3), F.lit(fixed.DAMAGED_NOTICE))
        .otherwise(shown)
    )


def summary_line(c_role: Column, c_content: Column, max_chars: int = 240) -> Column:
    """One line per message: role label, white space collapsed, long content cut."""
    flat = strip(F.regexp_replace(c_content, r"(?U)\s+", " "))
    cut = F.when(
        F.length(flat) > max_chars,
        F.concat(F.substring(flat, 1, max_chars - 3), F.lit("...")),
    ).otherwise(flat)
    label = F.when(c_role == "user", F.lit(fixed.USER_LABEL)).otherwise(
        F.lit(fixed.ASSISTANT_LABEL)
    )
    return F.concat(label, F.lit("："), cut)
