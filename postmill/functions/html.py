"""Extraction from HTML: items by position, descendants by attribute, text content."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def elements(html: Column, tag: str) -> Column:
    """The inner HTML of every element of a kind, in order; elements of that kind must not contain each other."""
    return F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"), F.lit(1))


def nth(html: Column, tag: str, k: Column | int, offset: int = 0) -> Column:
    """The k-th element, counted from 1 and moved by ``offset``; NULL where there is none."""
    return F.try_element_at(elements(html, tag), F.lit(k).cast("int") + offset)


def by_attribute(html: Column, tag: str, name: str, value: str) -> Column:
    """The inner HTML of the first element whose attribute has exactly this value; NULL where there is none."""
    pattern = rf'(?is)<{tag}\s(?:[^>]*\s)?{re.escape(name)}=["\']{re.escape(value)}["\'][^>]*>(.*?)</{tag}>'
    return F.when(html.rlike(pattern), F.regexp_extract(html, pattern, 1))


def text_content(html: Column) -> Column:
    """The text of a piece of HTML: tags off, the five basic entities decoded."""
    out = F.regexp_replace(html, "<[^>]*>", "")
    for entity, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(ch))
    return out


def escaped(text: Column) -> Column:
    """A text as HTML."""
    for ch, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(ch), F.lit(entity))
    return text


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.silent = 0

    def handle_starttag(self, tag, attrs):
        self.silent += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.silent -= tag in ("script", "style") and self.silent > 0

    def handle_data(self, data):
        if not self.silent:
            self.parts.append(data)


@F.pandas_udf(StringType())
def parsed_text(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The text of whole pages by a parser, without scripts and styles; broken HTML gives what can be read."""

    def one(page):
        if page is None:
            return None
        parser = _Text()
        parser.feed(page)
        parser.close()
        return "".join(parser.parts)

    for series in pages:
        yield series.map(one, na_action="ignore")
