"""Markdown structure as column expressions: header, sections, paragraphs, chunks."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, functions as F

from evidentia import fixed_values as fixed
from evidentia.functions.text import WHITE, lines, strip

_STATE = "struct<key:string,items:array<string>,open:boolean,entries:array<struct<key:string,values:array<string>,is_list:boolean>>>"
_STRINGS = "array<string>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once instead of wherever it occurs."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def split_front_matter(c: Column) -> Column:
    """``struct<header, body>``; no header (null) unless the text starts with a closed ``---`` block."""
    end = F.locate("\n---", c, 4)
    closed = F.startswith(c, F.lit("---")) & (end > 0)
    return F.struct(
        F.when(closed, strip(F.substring(c, F.lit(4), end - 4))).alias("header"),
        F.when(closed, strip(F.substring(c, end + 4, F.length(c)))).otherwise(c).alias("body"),
    )


def parse_front_matter(c_header: Column, keep_empty: bool = True) -> Column:
    """Header lines as ``array<struct<key, values, is_list>>``, in order.

    ``key: value`` gives one value, quotes removed; ``- x`` lines collect into a list
    for the key above them; ``[a, b]`` on one line stays a plain string. With
    ``keep_empty`` off, a value that is empty without its quotes is left out.
    """
    start = F.struct(
        F.lit(None).cast("string").alias("key"),
        F.array().cast(_STRINGS).alias("items"),
        F.lit(False).alias("open"),
        F.array().cast("array<struct<key:string,values:array<string>,is_list:boolean>>").alias("entries"),
    ).cast(_STATE)

    def close(s: Column) -> Column:
        ready = s["open"] & (F.coalesce(s["key"], F.lit("")) != "")
        entry = F.struct(s["key"].alias("key"), s["items"].alias("values"), F.lit(True).alias("is_list"))
        return F.struct(
            s["key"].alias("key"),
            F.when(ready, F.array().cast(_STRINGS)).otherwise(s["items"]).alias("items"),
            (s["open"] & ~ready).alias("open"),
            F.when(ready, F.concat(s["entries"], F.array(entry))).otherwise(s["entries"]).alias("entries"),
        ).cast(_STATE)

    def after_key(done: Column, f: Column) -> Column:
        has_value = (f["raw"] if keep_empty else f["value"]) != ""
        entry = F.struct(f["key"].alias("key"), F.array(f["value"]).alias("values"), F.lit(False).alias("is_list"))
        return F.struct(
            f["key"].alias("key"),
            done["items"].alias("items"),
            ((done["open"] & has_value) if keep_empty else F.lit(False)).alias("open"),
            F.when(has_value, F.concat(done["entries"], F.array(entry))).otherwise(done["entries"]).alias("entries"),
        ).cast(_STATE)

    def step(s: Column, line: Column) -> Column:
        item = F.startswith(line, F.lit("- ")) | F.startswith(line, F.lit("  - "))
        added = F.struct(
            s["key"].alias("key"),
            F.concat(s["items"], F.array(strip(F.regexp_replace(line, r"\A[- ]+", "")))).alias("items"),
            F.lit(True).alias("open"),
            s["entries"].alias("entries"),
        ).cast(_STATE)
        colon = F.locate(":", line)
        raw = strip(F.substring(line, colon + 1, F.length(line)))
        found = F.struct(
            strip(F.substring(line, F.lit(1), colon - 1)).alias("key"),
            raw.alias("raw"),
            F.btrim(raw, F.lit("'\"")).alias("value"),
        )
        keyed = _let(found, lambda f: _let(close(s), lambda done: after_key(done, f)))
        return F.when(item, added).when(colon > 0, keyed).otherwise(s)

    entries = F.aggregate(lines(c_header), start, step, lambda s: close(s)["entries"])
    none = F.array().cast("array<struct<key:string,values:array<string>,is_list:boolean>>")
    return F.coalesce(entries, none)


def meta_entry(c_entries: Column, key: str) -> Column:
    """The last entry of a key, or null."""
    mine = F.filter(c_entries, lambda e: e["key"] == key)
    return F.get(mine, F.size(mine) - 1)


def meta_value(c_entries: Column, key: str) -> Column:
    """The plain value of a key; null if it is absent or a list."""
    entry = meta_entry(c_entries, key)
    return F.when(~entry["is_list"], entry["values"][0])


def meta_map(c_entries: Column) -> Column:
    """All keys as ``map<string, array<string>>``; the last of equal keys wins."""
    last = F.filter(
        c_entries,
        lambda e, i: ~F.exists(
            F.slice(c_entries, i + 2, F.greatest(F.size(c_entries) - i - 1, F.lit(0))), lambda x: x["key"] == e["key"]
        ),
    )
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["key"], e["values"])))


def first_heading(c_body: Column) -> Column:
    found = F.regexp_extract(c_body, r"(?dm)^#\s+(.+)", 1)
    return F.when(F.rlike(c_body, F.lit(r"(?dm)^#\s+(.+)")), strip(found))


def split_sections(c_body: Column, c_section: Column, keep_preamble: bool = False) -> Column:
    """``array<struct<section, body, headed>>``; text before the first H2 is dropped by default."""
    parts = F.split(c_body, r"(?dm)^(?=## .)", -1)
    is_section = lambda p: F.rlike(p, F.lit(r"\A## ."))
    base = F.coalesce(c_section, F.lit(""))

    def headed(rows: Column) -> Column:
        title = strip(F.regexp_replace(rows[0], r"\A#+", ""))
        return F.struct(
            F.when(base != "", F.concat(base, F.lit(" > "), title)).otherwise(title).alias("section"),
            strip(F.array_join(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), "\n")).alias("body"),
            F.lit(True).alias("headed"),
        )

    whole = F.struct(base.alias("section"), c_body.alias("body"), F.lit(False).alias("headed"))
    sections = F.transform(F.transform(F.filter(parts, is_section), lambda p: lines(strip(p))), headed)
    if keep_preamble:
        lead = F.struct(base.alias("section"), strip(parts[0]).alias("body"), F.lit(False).alias("headed"))
        sections = F.when(~is_section(parts[0]), F.concat(F.array(lead), sections)).otherwise(sections)
    return F.when(F.exists(parts, is_section), sections).otherwise(F.array(whole))


# The white space of Java's Unicode character class, without the separator controls.
_BLANK_LINE = re.compile("\n[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]*\n")
_SENTENCE_END = re.compile(r"(?<=[。！？\n])")


def split_paragraphs(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"\n(?U:\s)*\n", -1), strip), lambda p: p != "")


def pack_paragraphs(c_paragraphs: Column, max_chars: int = fixed.CHUNK_MAX_CHARS) -> Column:
    """Join neighbours with a blank line while the result stays within ``max_chars``."""

    @F.arrow_udf(_STRINGS)
    def packs(rows: pa.Array) -> pa.Array:
        return pa.array([None if p is None else _packed(p, max_chars) for p in rows.to_pylist()], type=pa.list_(pa.string()))

    return packs(c_paragraphs)


def split_long(c: Column, max_chars: int = fixed.CHUNK_MAX_CHARS) -> Column:
    """Cut after sentence ends and refill to at most ``max_chars``; a longer sentence stays whole."""

    @F.arrow_udf(_STRINGS)
    def parts(rows: pa.Array) -> pa.Array:
        return pa.array([None if t is None else _cut_long(t, max_chars) for t in rows.to_pylist()], type=pa.list_(pa.string()))

    return parts(c)


def _packed(paragraphs: Sequence[str], max_chars: int) -> list[str]:
    out, held, size = [], [], 0
    for paragraph in paragraphs:
        if held and size + len(paragraph) + 2 <= max_chars:
            held.append(paragraph)
            size += len(paragraph) + 2
            continue
        if held:
            out.append("\n\n".join(held))
        held, size = [paragraph], len(paragraph)
    return [*out, "\n\n".join(held)] if held else out


def _cut_long(text: str, max_chars: int) -> list[str]:
    out, held, size = [], [], 0
    for sentence in filter(None, _SENTENCE_END.split(text)):
        if held and size + len(sentence) > max_chars:
            out.append("".join(held).strip(WHITE))
            held, size = [], 0
        held.append(sentence)
        size += len(sentence)
    if last := "".join(held).strip(WHITE):
        out.append(last)
    return out or [text[:max_chars]]


def _section_pieces(body: str, cut: bool, max_chars: int, min_chars: int) -> list[str]:
    paragraphs = [p for p in (part.strip(WHITE) for part in _BLANK_LINE.split(body)) if p]
    pieces = []
    for packed in _packed(paragraphs, max_chars):
        if len(packed) >= min_chars:
            pieces += _cut_long(packed, max_chars) if cut and len(packed) > max_chars else [packed]
    return [p for p in (piece.strip(WHITE) for piece in pieces) if len(p) >= min_chars]


_ROWS = 256
_PIECES = "array<struct<section:string,content:string>>"


def chunks_of(
    c_body: Column, c_section: Column,
    max_chars: int = fixed.CHUNK_MAX_CHARS, min_chars: int = fixed.CHUNK_MIN_CHARS,
    split_long_always: bool = False, keep_preamble: bool = False,
) -> Column:
    """``array<struct<section, content>>`` in document order; pieces under ``min_chars`` are dropped.

    Filling pieces is a running sum with resets. A fold over arrays copies its list at
    each step, so this part works on Arrow batches, in time linear in the text.
    """

    @F.arrow_udf(_PIECES)
    def pieces(rows: pa.Array) -> pa.Array:
        kind, parts = pa.list_(pa.struct([("section", pa.string()), ("content", pa.string())])), []
        # A slice of rows at a time is held as objects.
        for start in range(0, len(rows), _ROWS):
            out = [
                None if sections is None else [
                    {"section": s["section"], "content": piece}
                    for s in sections
                    for piece in _section_pieces(s["body"] or "", s["headed"] or split_long_always, max_chars, min_chars)
                ]
                for sections in rows.slice(start, _ROWS).to_pylist()
            ]
            parts.append(pa.array(out, type=kind))
        return pa.concat_arrays(parts) if parts else pa.array([], type=kind)

    return pieces(split_sections(c_body, c_section, keep_preamble))


def embed_text(
    c_title: Column, c_section: Column, c_tags: Column, c_content: Column,
    labels: Mapping[str, str] = fixed.EMBED_LABELS, separator: str = fixed.TAG_SEPARATOR,
) -> Column:
    """Content with its title, section and tags in front, each only if present."""
    tags = F.array_join(F.coalesce(c_tags, F.array().cast(_STRINGS)), separator)

    def labelled(name: str, c: Column) -> Column:
        value = F.coalesce(c, F.lit(""))
        return F.when(value != "", F.concat(F.lit(labels[name]), value))

    prefix = F.concat_ws("\n", labelled("title", c_title), labelled("section", c_section), labelled("tags", tags))
    return F.when(prefix != "", F.concat(prefix, F.lit("\n\n"), c_content)).otherwise(c_content)
