"""HTML pages to plain text blocks."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Elements whose content is not text of the page, and those that end a block.
SKIPPED = ("script", "style", "noscript", "template", "head", "iframe", "svg")
BLOCKS = ("p", "div", "section", "article", "ul", "ol", "blockquote", "pre", "header", "footer", "main", "nav", "br", "body", "aside", "dl", "dt", "dd", "figure", "figcaption", "address", "form", "fieldset", "hr")


class _Page(HTMLParser):
    """Collects blocks: headings as '#' lines, list items as '- ' lines, tables as pipe rows, a caption first."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[str] = []
        self.words: list[str] = []
        self.hidden, self.prefix = 0, ""
        self.table: list[list[str]] | None = None
        self.caption, self.cell = "", None
        #: Tables around the present one: their rows, caption, open cell and its words.
        self.outer: list[tuple] = []

    def _flush(self) -> None:
        line = " ".join("".join(self.words).split())
        self.words = []
        if line:
            self.blocks.append(self.prefix + line)
        self.prefix = ""

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self.hidden += 1
        elif tag == "table":
            if self.table is None:
                self._flush()
            else:
                self.outer.append((self.table, self.caption, self.cell, self.words))
            self.table, self.caption, self.cell, self.words = [], "", None, []
        elif self.table is not None:
            if tag in ("tr", "td", "th", "caption"):
                # A cell without an end tag ends where the next begins.
                self._end_cell()
            if tag == "tr" or tag in ("td", "th") and not self.table:
                self.table.append([])
            if tag in ("td", "th", "caption"):
                self.cell, self.words = tag, []
            elif tag in BLOCKS or tag == "li":
                self.words.append(" ")
        elif tag in BLOCKS or tag == "li" or tag[0] == "h" and tag[1:].isdigit():
            self._flush()
            self.prefix = "- " if tag == "li" else "#" * int(tag[1:]) + " " if tag[0] == "h" and tag[1:].isdigit() else ""

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "table" and self.table is not None:
            self._close_table()
        elif self.table is not None:
            if tag in ("td", "th", "caption", "tr"):
                self._end_cell()
            elif tag in BLOCKS or tag == "li":
                self.words.append(" ")
        elif tag in BLOCKS or tag == "li" or tag[0] == "h" and tag[1:].isdigit():
            self._flush()

    def _end_cell(self) -> None:
        text = " ".join("".join(self.words).split())
        if self.cell == "caption":
            self.caption = text
        elif self.cell and self.table:
            self.table[-1].append(text.replace("|", "\\|"))
        if self.cell:
            self.cell, self.words = None, []

    def _close_table(self) -> None:
        self._end_cell()
        rows = [r for r in self.table if any(r)]
        width = max(map(len, rows), default=0)
        lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
        if lines:
            lines.insert(1, "| " + " | ".join(["---"] * width) + " |")
        text = "\n".join([self.caption] * bool(self.caption) + lines)
        if self.outer:
            # A table inside a cell is part of that cell's text.
            self.table, self.caption, self.cell, self.words = self.outer.pop()
            self.words.append(" " + " ".join(" ".join(r) for r in rows).replace("\\|", "|") + " ")
            return
        if text:
            self.blocks.append(text)
        self.table, self.words = None, []

    def handle_data(self, data):
        if not self.hidden:
            self.words.append(data)


def page_text(html: str | None) -> str:
    page = _Page()
    page.feed(html or "")
    page.close()
    while page.table is not None:
        page._close_table()
    page._flush()
    return "\n\n".join(page.blocks)


@F.pandas_udf(StringType())
def _parse(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in pages:
        yield batch.map(page_text)


def html_text(html: Column) -> Column:
    """Blocks of a page, joined by blank lines; unclosed elements end with the page."""
    return _parse(html)
