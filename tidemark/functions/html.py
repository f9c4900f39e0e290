"""Tags of an HTML text, by expressions and, where nesting matters, by the standard parser."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# What is not markup, the start of an anchor up to its address, the start of a paragraph.
HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
ANCHOR = r"""(?i)<a(?:\s[^>]*?)?\shref\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)"""
PARAGRAPH = r"(?i)<p(?:\s[^>]*)?/?>"


def visible(html: Column) -> Column:
    """Without comments, scripts and style sheets."""
    return F.regexp_replace(html, HIDDEN, "")


def hrefs(html: Column) -> Column:
    """The addresses of all anchors, in order, entities decoded."""
    found = F.regexp_extract_all(visible(html), F.lit(ANCHOR), F.lit(1))
    return F.transform(found, lambda x: unescape(F.when(F.left(x, F.lit(1)).isin('"', "'"), F.substring(x, F.lit(2), F.length(x) - 2)).otherwise(x)))


def unescape(text: Column) -> Column:
    # Entities in the order in which they can be replaced.
    for name, char in (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def open_paragraphs(html: Column) -> Column:
    """How many paragraphs begin; none without a text."""
    return F.coalesce(F.regexp_count(visible(html), F.lit(PARAGRAPH)).cast("long"), F.lit(0).cast("long"))


def toplevel_paragraphs(html: Column) -> Column:
    """How many paragraphs begin outside any other, where an unclosed one goes on to the end."""

    class Depth(HTMLParser):
        def __init__(self):
            super().__init__()
            self.open, self.found = 0, 0

        def handle_starttag(self, tag, attrs):
            if tag == "p":
                self.found += not self.open
                self.open += 1

        def handle_startendtag(self, tag, attrs):
            self.found += tag == "p" and not self.open

        def handle_endtag(self, tag):
            if tag == "p" and self.open:
                self.open -= 1

    def count(text: str | None) -> int:
        parser = Depth()
        parser.feed(text or "")
        parser.close()
        return parser.found

    @F.pandas_udf("long")
    def counts(texts: pd.Series) -> pd.Series:
        return texts.map(count)

    return counts(html)
