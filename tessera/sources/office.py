"""Word and Excel files, read from their XML parts with the standard library."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def pipe_table(rows: list[list[str]]) -> str:
    """Rows as a pipe table: white space collapsed, pipes escaped, empty rows and trailing empty columns dropped."""
    rows = [[" ".join(c.split()).replace("|", "\\|") for c in r] for r in rows]
    rows = [r for r in rows if any(r)]
    width = max((i + 1 for r in rows for i, c in enumerate(r) if c), default=0)
    lines = ["| " + " | ".join((r + [""] * width)[:width]) + " |" for r in rows]
    return "\n".join([*lines[:1], *(["| " + " | ".join(["---"] * width) + " |"] if lines else []), *lines[1:]])


def docx_text(data: bytes) -> str:
    """Body blocks in order: paragraphs, headings by their style as '#' lines, tables as pipe tables."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{_W}body")
    words = lambda node: "".join(t.text or "" for t in node.iter(f"{_W}t"))
    out = []
    for block in body:
        if block.tag == f"{_W}p":
            style = block.find(f"{_W}pPr/{_W}pStyle")
            level = re.fullmatch(r"(?i)heading\s*(\d)", style.get(f"{_W}val", "")) if style is not None else None
            text = " ".join(words(block).split())
            if text:
                out.append("#" * min(6, int(level[1])) + " " + text if level else text)
        elif block.tag == f"{_W}tbl":
            out.append(pipe_table([[words(c) for c in r.iter(f"{_W}tc")] for r in block.iter(f"{_W}tr")]))
    return "\n\n".join(b for b in out if b)


def xlsx_text(data: bytes, stem: str = "workbook") -> str:
    """'# stem', then for each sheet with cells its name and a pipe table."""
    book = zipfile.ZipFile(io.BytesIO(data))
    shared = []
    if "xl/sharedStrings.xml" in book.namelist():
        shared = ["".join(t.text or "" for t in s.iter(f"{_S}t")) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_S}si")]
    names = [s.get("name") for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_S}sheet")]
    out = [f"# {stem}"]
    for k, name in enumerate(names, 1):
        rows = []
        for row in ElementTree.fromstring(book.read(f"xl/worksheets/sheet{k}.xml")).iter(f"{_S}row"):
            cells: list[str] = []
            for cell in row.iter(f"{_S}c"):
                column = 0
                for letter in re.match(r"[A-Z]*", cell.get("r", ""))[0]:
                    column = column * 26 + ord(letter) - 64
                value, inline = cell.find(f"{_S}v"), "".join(t.text or "" for t in cell.iter(f"{_S}t"))
                text = inline or (value.text or "" if value is not None else "")
                if cell.get("t") == "s":
                    text = shared[int(text)]
                cells += [""] * (column - 1 - len(cells)) + [text]
            rows.append(cells)
        if table := pipe_table(rows):
            out += [f"## {name}", table]
    return "\n\n".join(out)


def _each(read):
    @F.pandas_udf(StringType())
    def parse(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda data: None if data is None else read(bytes(data)))

    return parse


def parse_docx(content: Column) -> Column:
    return _each(docx_text)(content)


def parse_xlsx(content: Column) -> Column:
    return _each(xlsx_text)(content)
