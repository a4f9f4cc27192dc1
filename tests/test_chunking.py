"""Chunks, office files and parents with known answers."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from tessera.functions import chunking
from tessera.sources import office


def test_sections_follow_headings():
    text = "intro\n# A\n\n## B\nbody\n```\n# not a heading\n```\n### C\n\n## D\nlast"
    assert chunking.sections(text) == [("概览", "intro"), ("A > B", "body\n```\n# not a heading\n```"), ("A > D", "last")]


def test_long_paragraphs_are_cut_at_sentences():
    text = "。".join(f"第{i}句话内容3.5元" for i in range(400)) + "。"
    pieces = chunking.cut_paragraph(text, 600)
    assert all(len(p) <= 600 for p in pieces) and pieces[0] + "".join(p[chunking.OVERLAP :] for p in pieces[1:]) == text
    assert all(p.endswith("。") for p in pieces)
    rows = ["| a | b |", "| --- | --- |", *[f"| {i} | {'x' * 40} |" for i in range(40)]]
    cut = chunking.cut_paragraph("\n".join(rows), 500)
    assert all(c.startswith("| a | b |\n| --- | --- |") and len(c) <= 500 for c in cut)


def test_units_and_windows():
    assert chunking.units(["x" * 1000, "x" * 900, "x" * 500, "x" * 5000, "x"]) == [0, 0, 1, 2, 3]
    unit = "a" * 3000 + "MID" + "b" * 3000
    window = chunking.parent_window(unit, "MID")
    assert len(window) == 4000 and "MID" in window and chunking.parent_window(unit, "nowhere") == ""
    assert chunking.label("退货政策", "退货政策 > 期限") == "【退货政策 · 期限】\n"


def test_documents_keep_all_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.concat(F.lit("d"), "doc_id").alias("doc"), "text")
    found = chunking.chunk_documents(docs).collect()
    assert max(len(r["text"]) for r in found) <= chunking.MOST and len({r["chunk_id"] for r in found}) == len(found)
    by: dict[str, str] = {}
    for r in sorted(found, key=lambda r: (r["section"], r["sub"])):
        by[r["chunk_id"].split("#")[0]] = by.get(r["chunk_id"].split("#")[0], "") + " " + r["text"]
    for r in docs.collect():
        words = {w for w in r["text"].split() if not w.startswith("#")}
        assert len(words - set(by[r["doc"]].split())) <= len(words) * 0.05


def test_parents_join_sections(spark):
    rows = [("d", 1, 0, "a", ""), ("d", 1, 1, "b", ""), ("d", 2, 0, "c", ""), ("e", 1, 0, "x", "p"), ("e", 1, 1, "y", "")]
    found = chunking.attach_parents(spark.createDataFrame(rows, "doc string, section int, sub int, text string, parent_id string"))
    assert {(r["doc"], r["section"], r["sub"]): r["parent_text"] for r in found.collect()} == {("d", 1, 0): "a\n\nb", ("d", 1, 1): "a\n\nb", ("d", 2, 0): "", ("e", 1, 0): "", ("e", 1, 1): ""}


def test_a_document_without_room_is_rejected_alone(spark):
    docs = spark.createDataFrame([("d" * 1150, "# A\ntext"), ("fine", "# A\ntext"), ("none", None)], "doc string, text string")
    assert [(r["doc"], r["reason"]) for r in chunking.rejected_documents(docs).collect()] == [("d" * 1150, "label too long")]
    found = [r["chunk_id"] for r in chunking.chunk_documents(docs).collect()]
    assert "fine#00-00" in found and not any(i.startswith("dd") for i in found)


def _zip(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


def test_office_files(spark):
    w, s = "http://schemas.openxmlformats.org/wordprocessingml/2006/main", "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    p = lambda t, style="": f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{style}{chr(34)}/></w:pPr>" if style else ""}<w:r><w:t>{t}</w:t></w:r></w:p>'
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    docx = _zip({"word/document.xml": f'<w:document xmlns:w="{w}"><w:body>{p("Title", "Heading1")}{p("text")}<w:tbl><w:tr>{cell("a")}{cell("b|c")}</w:tr><w:tr>{cell("1")}{cell("2")}</w:tr></w:tbl></w:body></w:document>'})
    xlsx = _zip({
        "xl/workbook.xml": f'<workbook xmlns="{s}"><sheets><sheet name="One"/></sheets></workbook>', "xl/sharedStrings.xml": f'<sst xmlns="{s}"><si><t>name</t></si></sst>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{s}"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>3</v></c></row><row/><row><c r="B3" t="inlineStr"><is><t>x</t></is></c></row></sheetData></worksheet>',
    })
    row = spark.createDataFrame([(bytearray(docx), bytearray(xlsx))], "d binary, x binary").select(office.parse_docx(F.col("d")).alias("d"), office.parse_xlsx(F.col("x")).alias("x")).first()
    assert row["d"] == "# Title\n\ntext\n\n| a | b\\|c |\n| --- | --- |\n| 1 | 2 |"
    assert row["x"] == "# workbook\n\n## One\n\n| name |  | 3 |\n| --- | --- | --- |\n|  | x |  |"


def test_chunks_are_handed_on_in_parts():
    docs = pd.DataFrame({"doc": [f"d{i}" for i in range(3000)], "text": ["one paragraph\n\nanother"] * 3000})
    parts = list(chunking._cut(iter([docs])))
    assert max(map(len, parts)) <= chunking.CHUNKS_AT_ONCE + 2 and len({d for p in parts for d in p.iloc[:, 0]}) == sum(map(len, parts)) >= 3000
