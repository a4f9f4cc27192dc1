"""Chunks of Markdown documents: sections by headings, packed paragraphs, cut sentences, parents and labels."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Sizes in characters.
TARGET, MOST, OVERLAP, UNIT, UNIT_MOST, LABEL_MOST = 900, 1200, 120, 1800, 4000, 240
INTRODUCTION = "概览"

CHUNKS = "chunk_id string, parent_id string, section int, sub int, heading_path string, text string, parent_text string"

_HEADING = re.compile(r"(#{1,6})\s+(.*)")
#: Where a long paragraph may be cut: after sentence ends that don't stand between digits.
_CUT = re.compile(r"(?<=[。！？；!?;])|(?<=\.)(?!\d)")


def sections(text: str) -> list[tuple[str, str]]:
    """(heading path, body) in order; headings inside fences don't count, sections without a body are left out."""
    path: list[tuple[int, str]] = []
    out: list[tuple[str, list[str]]] = [(INTRODUCTION, [])]
    fenced = False
    for line in text.split("\n"):
        if line.lstrip().startswith("```"):
            fenced = not fenced
        found = None if fenced else _HEADING.match(line)
        if found:
            level = len(found[1])
            path = [p for p in path if p[0] < level] + [(level, found[2].strip())]
            out.append((" > ".join(title for _, title in path), []))
        else:
            out[-1][1].append(line)
    return [(title, body) for title, lines in out if (body := "\n".join(lines).strip())]


def cut_paragraph(paragraph: str, room: int) -> list[str]:
    """Pieces of at most ``room``: rows of tables stay whole, sentences are packed, each piece starts with the end of the one before."""
    table = all(x.startswith("|") for x in paragraph.split("\n"))
    parts = [x + "\n" for x in paragraph.split("\n")] if table else _CUT.split(paragraph)
    head = "".join(parts[:2]) if table and len(parts) > 2 and set(parts[1]) <= set("|-: \n") else ""
    limit = room - (len(head) if head else OVERLAP)
    out, held = [], ""
    for part in parts:
        while len(part) > limit:
            if held:
                out.append(held)
                held = ""
            out.append(part[:limit])
            part = part[limit:]
        if len(held) + len(part) > limit and held:
            out.append(held)
            held = ""
        held += part
    out += [held] if held else []
    if head:
        return [out[0].strip(), *[(head + x).strip() for x in out[1:]]]
    return [x if i == 0 or table else out[i - 1][-OVERLAP:] + x for i, x in enumerate(out)]


def pack_paragraphs(body: str, target: int, most: int) -> list[str]:
    """Paragraphs joined up to the target; one that is too long on its own is cut."""
    out, held = [], ""
    for paragraph in re.split(r"\n\s*\n", body):
        if len(paragraph) > most:
            out += [held] if held else []
            held = ""
            out += cut_paragraph(paragraph, most)
        elif held and len(held) + 2 + len(paragraph) > target:
            out.append(held)
            held = paragraph
        else:
            held = f"{held}\n\n{paragraph}" if held else paragraph
    return out + ([held] if held else [])


def units(bodies: list[str]) -> list[int]:
    """The unit of each section: neighbours share one until it has UNIT characters; none grows beyond UNIT_MOST."""
    out, size, unit = [], 0, 0
    for body in bodies:
        if size and (size >= UNIT or size + 2 + len(body) > UNIT_MOST):
            unit, size = unit + 1, 0
        out.append(unit)
        size += len(body) + (2 if size else 0)
    return out


def label(doc: str, path: str) -> str:
    """Document and heading path; a title that repeats the document's name is left out, a long path keeps its ends."""
    parts = path.split(" > ")
    if len(parts) > 1 and (parts[0].endswith(doc) or doc.endswith(parts[0])) and abs(len(parts[0]) - len(doc)) <= 8:
        parts = parts[1:]
    name = " > ".join(parts)
    if len(name) > LABEL_MOST:
        name = f"{parts[0][: LABEL_MOST // 2 - 4]} > … > {parts[-1][: LABEL_MOST // 2 - 4]}"
    return f"【{doc} · {name}】\n"


def parent_window(unit: str, piece: str) -> str:
    """The unit, or UNIT_MOST characters of it around the piece; empty if the piece isn't in it whole."""
    at = unit.find(piece)
    if at < 0 or len(piece) > UNIT_MOST:
        return ""
    start = max(0, min(at - (UNIT_MOST - len(piece)) // 2, len(unit) - UNIT_MOST))
    return unit[start : start + UNIT_MOST]


#: Chunks, each with its parent, after which a task hands them on; a batch of documents has many times its own size in them.
CHUNKS_AT_ONCE = 1000


class NoRoom(ValueError):
    """A label leaves too little of a chunk for text."""


def chunks_of(doc: str, text: str) -> list[tuple]:
    found = sections(text)
    of_unit = units([body for _, body in found])
    joined = {u: "\n\n".join(b for (_, b), v in zip(found, of_unit, strict=True) if v == u) for u in set(of_unit)}
    out = []
    for s, ((path, body), unit) in enumerate(zip(found, of_unit, strict=True)):
        prefix = label(doc, path)
        most = MOST - len(prefix)
        if most < 100:
            raise NoRoom(f"no room for text beside the label of {doc}")
        for k, piece in enumerate(pack_paragraphs(body, min(TARGET, most), most)):
            out.append((f"{doc}#{s:02d}-{k:02d}", f"{doc}#u{unit:02d}", s, k, path, prefix + piece, parent_window(joined[unit], piece)))
    return out


def _chunks_or_none(doc: str, text: str) -> list[tuple] | None:
    try:
        return chunks_of(doc, text)
    except NoRoom:
        return None


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The chunks of the batches' documents, CHUNKS_AT_ONCE at a time."""
    names = [c.split()[0] for c in CHUNKS.split(", ")]
    for batch in batches:
        rows = []
        for doc, text in zip(batch["doc"], batch["text"], strict=True):
            rows += _chunks_or_none(doc, text or "") or ()
            if len(rows) >= CHUNKS_AT_ONCE:
                yield pd.DataFrame(rows, columns=names)
                rows = []
        if rows:
            yield pd.DataFrame(rows, columns=names)


def chunk_documents(docs: DataFrame) -> DataFrame:
    """The chunks of documents (doc, text), in any order; a document is chunked on its own. Documents without room beside a label have none: see rejected_documents()."""
    return docs.select("doc", "text").mapInPandas(_cut, CHUNKS)


def rejected_documents(docs: DataFrame) -> DataFrame:
    """(doc, reason) of the documents that chunk_documents() leaves out."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            gone = [doc for doc, text in zip(batch["doc"], batch["text"], strict=True) if _chunks_or_none(doc, text or "") is None]
            if gone:
                yield pd.DataFrame({"doc": gone, "reason": ["label too long"] * len(gone)})

    return docs.select("doc", "text").mapInPandas(find, "doc string, reason string")


def attach_parents(chunks: DataFrame, most: int = UNIT_MOST) -> DataFrame:
    """Chunks (doc, section, sub, text, parent_id) of a section of several without a parent get their joined text, if it fits."""
    whole = Window.partitionBy("doc", "section")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("sub", "text")).over(whole)), lambda p: p["text"]), "\n\n")
    may = (F.count("*").over(whole) > 1) & (F.max(F.col("parent_id") != "").over(whole) == F.lit(False)) & (F.length(joined) <= most)
    return chunks.withColumn("parent_text", F.when(may, joined).otherwise(""))
