"""Substring dedup: repeated windows of words, found by level-wise doubling.

Level 0 looks at windows of half the length only, and of these at the least hash among
those inside each full window: if a full window repeats, so does that one. Windows repeated
there alone are extended to twice the length at level 1, those repeated to twice that, until
the full length is reached or no candidates survive. At the full length a word is removed if a window
over it also starts in a document with a smaller id.

Defined results: null text has no words; white space is bytes 9-13 and 32;
documents with equal ids don't remove from each other; a null id counts as
larger than every other; an empty table gives none. Other columns pass through, whatever their names.
Windows are equal if 64-bit hashes of their words, mixed eight bytes at a time, are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tessera.llm._shared import ANSWER, SENT, answered, answers_of, first_elsewhere, in_chunks, in_several, sent
from tessera.llm._words import Words, among, dealt, keys_of, text_slices

WINDOW = 13


def ladder(window: int) -> list[int]:
    """Lengths of the levels: the window, its half and so on down to at least 7 words."""
    lengths = [window]
    while lengths[0] > 14:
        lengths.insert(0, -(-lengths[0] // 2))
    return [-(-lengths[0] // 2), *lengths]


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of ``width`` values."""
    out = values[: max(0, len(values) - width + 1)].copy()
    for k in range(1, width):
        np.minimum(out, values[k : k + len(out)], out=out)
    return out


class _Chunk:
    """The windows of a chunk at each level, with what the buckets have answered so far."""

    def __init__(self, table: pa.Table, lengths: list[int]):
        self.table, self.lengths, self.keys = table, lengths, keys_of(table)
        self.slices = [(lo, Words(data, bounds)) for lo, _, data, bounds in text_slices(table)]

    def anchors(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of each slice: at each window of level 1 the least hash of level 0 inside it, the document's key, and whether the window exists."""
        half, full = self.lengths[:2]
        out = []
        for lo, words in self.slices:
            least, (_, inside) = _least(words.windows(half)[0], full - half + 1), words.windows(full)
            out.append((least, self.keys[lo + words.text[: len(inside)]], inside))
        return out

    def at(self, length: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        out = []
        for lo, words in self.slices:
            hashes, inside = words.windows(length)
            out.append((hashes, self.keys[lo + words.text[: len(hashes)]], inside))
        return out

    @staticmethod
    def firsts(found: list, marks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct marked hashes, each one's first document here, and whether it is in two documents here."""
        hashes = np.concatenate([h[m] for (h, _, _), m in zip(found, marks, strict=True)] or [np.zeros(0, np.uint64)])
        keys = np.concatenate([k[m] for (_, k, _), m in zip(found, marks, strict=True)] or [np.zeros(0, np.int64)])
        if not len(hashes):
            return hashes, keys, np.zeros(0, bool)
        order = np.argsort(hashes, kind="stable")
        hashes, keys = hashes[order], keys[order]
        starts = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
        first = np.minimum.reduceat(keys, starts)
        return hashes[starts], first, np.maximum.reduceat(keys, starts) > first

    def candidates(self, level: int, answers: pa.Table) -> tuple[list, list[np.ndarray]]:
        """The windows of a level, and which of them may repeat by the levels below."""
        found = self.anchors()
        marks = [inside for _, _, inside in found]
        for step in range(level):
            hashes, _, twice = self.firsts(found, marks)
            repeated = np.union1d(answers_of(answers, step), hashes[twice])
            shorter = [m & among(h, repeated) for (h, _, _), m in zip(found, marks, strict=True)]
            found = self.at(self.lengths[step + 1])
            if step == 0:
                marks = shorter
                continue
            gap = self.lengths[step + 1] - self.lengths[step]
            marks = [s[: len(h)] & s[gap : gap + len(h)] & inside for s, (h, _, inside) in zip(shorter, found, strict=True)]
        return found, marks


ADDED = ("n_words", "n_removed", "kept")


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with n_words, n_removed and kept (the words left, joined by one space).

    Added columns replace any of these names that docs has, in any case; others pass through, whatever their names.
    """
    names = [c for c in docs.columns if c.lower() not in ADDED]
    found = _cut(_packed(docs, names), window)
    return found.select(*_unpacked(names), *ADDED)


def _packed(docs: DataFrame, names: list[str]) -> DataFrame:
    """doc_id, text and the other columns in one, so that their names can't clash."""
    others = [F.col(c) for c in names if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", *([F.struct(*others).alias("_row")] if others else []))


def _unpacked(names: list[str]) -> list:
    return [F.col(c) if c in ("doc_id", "text") else F.col("_row")[c].alias(c) for c in names]


def _cut(docs: DataFrame, window: int) -> DataFrame:
    """docs (of names that don't clash) with ADDED."""
    lengths = ladder(window)
    chunks, buckets = in_chunks(docs)
    schema = StructType([f for f in chunks.schema if f.name != "chunk"] + [StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept", StringType())])

    def ask(level: int):
        def step(key: tuple[pa.Scalar, ...], table: pa.Table, answers: pa.Table) -> pa.Table:
            if not table.num_rows:
                return pa.table({"bucket": pa.array([], pa.int32()), "chunk": pa.array([], pa.int32()), "hashes": pa.array([], pa.binary()), "firsts": pa.array([], pa.binary())})
            chunk = _Chunk(table, lengths)
            hashes, first, _ = chunk.firsts(*chunk.candidates(level, answers))
            found, cut = dealt(hashes, buckets, first)
            # Only the last level needs to know which document is first.
            firsts = cut[1] if level == len(lengths) - 1 else pa.array([b""] * len(found), pa.binary())
            return sent(key[0].as_py(), found, cut[0], firsts)

        return step

    def removed(key: tuple[pa.Scalar, ...], table: pa.Table, answers: pa.Table) -> pa.Table:
        own = table.drop_columns(["chunk"])
        if not table.num_rows:
            return pa.Table.from_batches([], schema=_arrow(own.schema))
        chunk, last = _Chunk(table, lengths), len(lengths) - 1
        found = chunk.at(window)
        hashes, first, _ = chunk.firsts(found, [inside for _, _, inside in found])
        earlier = answers_of(answers, last)
        counts, gone, kept = [], [], []
        texts = (t or b"" for t in table.column("text").cast(pa.binary()).to_pylist())
        for (lo, words), (h, k, inside) in zip(chunk.slices, found, strict=True):
            drop = inside & (among(h, earlier) | (first[np.searchsorted(hashes, np.where(inside, h, hashes[0]))] < k)) if len(hashes) else np.zeros(len(h), bool)
            n = len(words.hash)
            starts = np.flatnonzero(drop)
            cover = np.cumsum(np.bincount(starts, minlength=n + 1)[: n + 1] - np.bincount(starts + window, minlength=n + 1)[: n + 1])[:n] > 0
            edges = np.searchsorted(words.text, np.arange(words.n_texts + 1))
            total = np.concatenate([[0], np.cumsum(cover)])
            for i in range(words.n_texts):
                a, b = edges[i], edges[i + 1]
                left, n_gone = next(texts).split(), int(total[b] - total[a])
                counts.append(b - a)
                gone.append(n_gone)
                kept.append(b" ".join([w for w, c in zip(left, cover[a:b].tolist(), strict=True) if not c] if n_gone else left))
        for name, values, kind in (("n_words", counts, pa.int64()), ("n_removed", gone, pa.int64()), ("kept", kept, pa.binary())):
            own = own.append_column(name, pa.array(values, kind).cast(pa.string()) if kind == pa.binary() else pa.array(values, kind))
        return own

    none = docs.sparkSession.createDataFrame([], ANSWER)
    answers, texts = none, chunks.groupBy("chunk")
    for level in range(len(lengths)):
        asked = texts.cogroup(answers.groupBy("chunk")).applyInArrow(ask(level), SENT)
        pick = first_elsewhere if level == len(lengths) - 1 else in_several
        found = answered(asked, buckets, level, pick)
        answers = found if level == 0 else answers.union(found) if level < len(lengths) - 1 else found
    return texts.cogroup(answers.groupBy("chunk")).applyInArrow(removed, schema)


def _arrow(schema: pa.Schema) -> pa.Schema:
    for name, kind in (("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())):
        schema = schema.append(pa.field(name, kind))
    return schema


def dedup_texts(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The corpus after the cut: changed texts hold the words left; documents that lost every word go."""
    found = _cut(_packed(docs, docs.columns), window)
    changed = F.col("n_removed") > 0
    text = F.when(changed, F.col("kept")).otherwise(F.col("text"))
    own = dict(zip(docs.columns, _unpacked(docs.columns), strict=True)) | {"text": text.alias("text")}
    if "n_chars" in own:
        own["n_chars"] = F.when(changed, F.length("kept").cast("long")).otherwise(F.col("_row")["n_chars"]).alias("n_chars")
    return found.where(~changed | (F.col("n_removed") < F.col("n_words"))).select(*own.values())
