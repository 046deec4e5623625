"""HTML allow-list cleaning, parsed per page inside Arrow batches."""

from __future__ import annotations

import html
import html.entities
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser
from urllib.parse import urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from evidentia import fixed_values as fixed

_VOID = frozenset({"br"})


class _Cleaner(HTMLParser):
    """Keeps allowed tags and all text; other tags, comments and attributes are left out."""

    def __init__(self, tags: frozenset[str], attributes: frozenset[str]):
        super().__init__(convert_charrefs=False)
        self.tags, self.attributes = tags, attributes
        self.out: list[str] = []
        self.open: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag not in self.tags:
            return
        kept = []
        for name, value in attrs if tag == "a" else ():
            if name in self.attributes and (name != "href" or _allowed_link(value or "")):
                kept.append(f' {name}="{html.escape(value or "", quote=False).replace(chr(34), "&quot;")}"')
        self.out.append(f"<{tag}{''.join(kept)}>")
        if tag not in _VOID:
            self.open.append(tag)

    def handle_endtag(self, tag):
        if tag not in self.open:
            return
        while self.open:
            last = self.open.pop()
            self.out.append(f"</{last}>")
            if last == tag:
                break

    def handle_data(self, data):
        self.out.append(html.escape(data, quote=False))

    def handle_entityref(self, name):
        self.out.append(f"&{name};" if f"{name};" in html.entities.html5 else f"&amp;{name}")

    def handle_charref(self, name):
        self.out.append(f"&#{name};")

    def result(self) -> str:
        self.close()
        self.out.extend(f"</{tag}>" for tag in reversed(self.open))
        return "".join(self.out)


def _allowed_link(value: str) -> bool:
    """Only http(s) links and links without a scheme."""
    try:
        scheme = urlparse("".join(ch for ch in value if ch > " ")).scheme
    except ValueError:
        return False
    return scheme in ("http", "https", "")


def sanitize(
    c_html: Column,
    tags: Sequence[str] = fixed.ALLOWED_TAGS,
    attributes: Sequence[str] = fixed.ALLOWED_LINK_ATTRIBUTES,
) -> Column:
    tags, attributes = frozenset(tags), frozenset(attributes)

    @F.pandas_udf("string")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(page):
            cleaner = _Cleaner(tags, attributes)
            cleaner.feed(page or "")
            return cleaner.result()

        for pages in batches:
            yield pages.map(one)

    return clean(c_html)


def sanitize_pages(pages: DataFrame, column: str = "html", out: str = "clean", **allowed) -> DataFrame:
    return pages.withColumn(out, sanitize(F.col(column), **allowed))
