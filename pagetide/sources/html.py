"""Web pages as text: the standard library's parser in Arrow batches."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Elements that are no content, elements that never close, and those that stand on lines of their own.
DROPPED = frozenset(("script", "style", "noscript", "nav", "header", "footer", "aside", "form", "button", "svg"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
BLOCK = frozenset(("address", "article", "blockquote", "dd", "div", "dl", "dt", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "li", "main", "ol", "p", "pre", "section", "table", "tr", "ul"))


class _Visible(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.open: list[str] = []  # dropped elements that are open
        self.head = 0

    def handle_starttag(self, tag, attrs):
        if tag in DROPPED:
            self.open.append(tag)
        elif tag in ("head", "title"):
            self.head += 1
        elif tag == "br" or tag in BLOCK:
            self.out.append("\n" if tag == "br" else "\n\n" if tag == "p" else "\n")

    def handle_startendtag(self, tag, attrs):
        if tag == "br":
            self.out.append("\n")

    def handle_endtag(self, tag):
        if tag in self.open:
            while self.open.pop() != tag:
                pass
        elif tag in ("head", "title"):
            self.head = max(0, self.head - 1)
        elif tag in BLOCK:
            self.out.append("\n\n" if tag == "p" else "\n")

    def handle_data(self, data):
        if not self.open and not self.head:
            self.out.append(re.sub(r"[ \t\r\n\f]+", " ", data))


def visible(html: str | None) -> str:
    """The text of a page without scripts, navigation, forms and the like; blank lines at most one at a time."""
    parser = _Visible()
    parser.feed(html or "")
    parser.close()
    lines = (re.sub(" +", " ", x).strip(" ") for x in "".join(parser.out).split("\n"))
    return re.sub("\n{3,}", "\n\n", "\n".join(lines)).strip()


@F.pandas_udf(StringType())
def visible_text(s: pd.Series) -> pd.Series:
    """visible() of a column; null counts as empty. How a browser lays text out is not reproduced."""
    return s.map(visible)
