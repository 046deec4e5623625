"""Column functions that classify and clean text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from evidentia import fixed_values as fixed
from evidentia.functions.text import strip


def redact_sensitive(c: Column) -> Column:
    return F.regexp_replace(c, fixed.SECRET_PATTERN, fixed.SECRET_MARK)


def is_sensitive(c: Column) -> Column:
    return F.rlike(c, F.lit(fixed.SECRET_PATTERN))


def hide_internal_references(c: Column) -> Column:
    return F.regexp_replace(c, fixed.INTERNAL_REFERENCE_PATTERN, fixed.INTERNAL_REFERENCE_MARK)


def classify_safety(c_question: Column) -> Column:
    """Why a question is refused (``direct``, ``protected``, ``file``, ``file_word``), or ``safe``."""
    q = F.regexp_replace(F.lower(c_question), r"(?U)\s+", "")
    direct = F.lit(False)
    for pattern in fixed.UNSAFE_PATTERNS:
        direct = direct | F.rlike(q, F.lit(f"(?i){pattern}"))
    return (
        F.when(direct, "direct")
        .when(~F.rlike(q, F.lit(fixed.EXTRACTION_PATTERN)), "safe")
        .when(F.rlike(q, F.lit(f"(?i){fixed.PROTECTED_PATTERN}")), "protected")
        .when(F.rlike(q, F.lit(f"(?i){fixed.FILE_REFERENCE_SIGN}")), "file")
        .when(F.rlike(q, F.lit(fixed.FILE_WORD_PATTERN)), "file_word")
        .otherwise("safe")
    )


def answer_scope(
    c_question: Column,
    strength_pattern: str = fixed.STRENGTH_PATTERN,
    weakness_pattern: str = fixed.WEAKNESS_PATTERN,
    fit_pattern: str = fixed.FIT_PATTERN,
) -> Column:
    """What an answer should keep to: ``strength``, ``weakness``, ``both``, ``fit`` or ``default``; the wording is the caller's."""
    q = F.lower(c_question)
    strength = F.rlike(q, F.lit(strength_pattern))
    weakness = F.rlike(q, F.lit(weakness_pattern))
    return (
        F.when(strength & weakness, "both")
        .when(strength, "strength")
        .when(weakness, "weakness")
        .when(F.rlike(q, F.lit(fit_pattern)), "fit")
        .otherwise("default")
    )


def safe_url(c_url: Column) -> Column:
    """The trimmed URL if it is http(s) with a host, else null."""
    url = strip(c_url)
    return F.when(F.rlike(url, F.lit(r"(?i)\Ahttps?://[^/?#]")), url)


def normalize_question(c: Column) -> Column:
    bare = F.regexp_replace(strip(c), r"(?U)[？?。.\s]+\z", "")
    return F.regexp_replace(bare, r"(?U)\s+", " ")


def compact_question(c: Column) -> Column:
    return F.lower(F.regexp_replace(normalize_question(c), r"[^\p{L}\p{N}]+", ""))


def is_greeting(c_question: Column, greetings=fixed.GREETINGS) -> Column:
    return compact_question(c_question).isin(*greetings)
