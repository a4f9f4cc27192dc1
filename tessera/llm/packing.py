"""Packing documents into training sequences by minimum bin slack.

Documents become token ids closed by id 0; only those longer than a sequence
are cut. A bin's content depends on lengths alone, and there are at most
``capacity`` lengths, so the bins are planned on the histogram of lengths: per
bin a bitset subset-sum over the available lengths finds the fullest feasible
combination beside the largest piece left, and it is removed as often as the counts allow. The plan
has some thousand rows at most, whatever the size of the corpus; each piece then looks up
its place by its length and its rank among pieces of that length.

Defined results: null text is the empty text and packs as the single id 0; equal
lengths are ranked by id, nulls first, and piece; repeated rows are packed each;
an empty table gives none.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import durable, global_index
from tessera.llm._words import give_back

CAPACITY = 2048
VOCABULARY = "word_bpe_49k.json"
#: Bytes of text that are split at once, and words whose ids a task remembers.
SEGMENT_BYTES, REMEMBERED = 1 << 22, 400_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = f"{PIECES}, sequence_id long, offset long"

#: The characters that a byte-level vocabulary writes for bytes that don't show.
_HIDDEN = [*range(0x21), *range(0x7F, 0xA1), 0xAD]
SHOWN = {byte: 0x100 + i for i, byte in enumerate(_HIDDEN)}


class WordIds(dict):
    """Ids of words, as little-endian 32-bit bytes; remembers a bounded number of them.

    White space always ends a token of this kind of vocabulary and leaves no
    token of its own, so a text's ids are its words' ids in a row. Letters, digits and marks don't share tokens
    either, so an ASCII word is made of its runs, and a plain run needs no more than the merges.
    """

    runs = re.compile(rb"[a-z]+|[0-9]|[^a-z0-9]+")
    ending = re.compile(rb"(.*[a-z])([.,;:!?*&%$#]+)", re.DOTALL)

    def __init__(self, path: str | None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or public_tokenizers.path(VOCABULARY))
        self.merges = self.tokenizer.model

    def merged(self, shown: str) -> bytes:
        return b"".join([t.id.to_bytes(4, "little") for t in self.merges.tokenize(shown)])

    @staticmethod
    def latin(word: str) -> bool:
        """Whether a word is of small Latin letters alone, which the vocabulary's rules leave as they are, accents included."""
        return word.isalpha() and max(word) <= "\u024f" and word == word.lower()

    def __missing__(self, word: bytes) -> bytes:
        if len(self) > REMEMBERED:
            self.clear()
        if word.isalpha() and word.islower():
            ids = self.merged(word.decode())
        elif not word.isascii() and self.latin(word.decode()):
            ids = self.merged(word.decode("latin-1").translate(SHOWN))
        else:
            parts = []
            if b"'" not in word and b"<|" not in word and word == word.lower():
                ended = None if word.isascii() else self.ending.fullmatch(word)
                parts = self.runs.findall(word) if word.isascii() else ended.groups() if ended else []
            if len(parts) > 1:
                ids = b"".join([self[p] for p in parts])
            else:
                ids = np.asarray(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids, "<u4").tobytes()
        self[word] = ids
        return ids

    def of(self, text: bytes) -> bytes:
        """A text that may hold a special token's string keeps its case, which matters there only."""
        return b"".join(map(self.__getitem__, (text if b"<|" in text else text.lower()).split()))

    def whole(self, text: bytes) -> bytes:
        """The ids of a text of any length, a segment at a time, cut at white space."""
        if len(text) <= SEGMENT_BYTES:
            return self.of(text)
        out, at = [], 0
        while at < len(text):
            end = at + SEGMENT_BYTES
            while end < len(text) and text[end] not in b" \t\n\r\x0b\x0c":
                end += 1
            out.append(self.of(text[at:end]))
            at = end
        return b"".join(out)


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece of every document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        ids = WordIds(path)
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
        for batch in batches:
            keys = batch.column(0).to_pylist()
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            rows = []
            for key, text in zip(keys, texts, strict=True):
                blob = ids.whole(text) + b"\0\0\0\0"
                for k in range(0, len(blob), 4 * capacity):
                    part = blob[k : k + 4 * capacity]
                    rows.append((key, k // (4 * capacity), k // 4, len(part) // 4, zlib.crc32(part)))
            columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
        ids.clear()
        give_back()

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


def fullest(room: int, counts: np.ndarray) -> list[tuple[int, int]]:
    """[(length, times)] whose sum comes nearest to room, of counts[length] pieces each.

    Bit s of a set says that sum s can be reached. Lengths join from the longest
    down, and the way back uses the short ones only where the long ones fail, so short pieces are kept for later bins.
    """
    full = (1 << room + 1) - 1
    reach, steps = 1, []
    for length in (np.flatnonzero(counts[1 : room + 1])[::-1] + 1).tolist():
        steps.append((length, reach))
        left, part = min(int(counts[length]), room // length), 1
        while left:
            part = min(part, left)
            reach |= reach << part * length & full
            left -= part
            part *= 2
        if reach >> room & 1:
            break
    target, out = reach.bit_length() - 1, []
    for length, before in reversed(steps):
        times = 0
        while not before >> target & 1:
            target -= length
            times += 1
        if times:
            out.append((length, times))
    return out


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first rank, pieces a bin, first bin, offset in the bin), sorted by length and first rank."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    used, rows, bins = np.zeros_like(counts), [], 0
    for seed in range(capacity, 0, -1):
        while counts[seed]:
            counts[seed] -= 1
            combination = dict(fullest(capacity - seed, counts))
            counts[seed] += 1
            combination[seed] = combination.get(seed, 0) + 1
            times = min(int(counts[length]) // n for length, n in combination.items())
            offset = 0
            for length, n in sorted(combination.items(), reverse=True):
                rows.append((length, int(used[length]), n, bins, offset))
                used[length] += times * n
                counts[length] -= times * n
                offset += n * length
            bins += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """Every piece with its sequence and its offset there."""
    ranked = global_index(durable(pieces(docs, capacity, path)), [F.col("length"), F.col("doc_id").asc_nulls_first(), F.col("piece"), F.col("ids_crc32")], "_rank")
    # At most ``capacity`` rows come to the driver.
    histogram = {r["length"]: r["count"] for r in ranked.groupBy("length").count().collect()}
    plan = plan_bins(histogram, capacity)
    first = np.zeros(capacity + 2, np.int64)
    for length, n in histogram.items():
        first[length + 1] = n
    first = np.cumsum(first)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = plan[:, 0] << 50 | plan[:, 1] if len(plan) else plan[:, 0]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            rank = rank - first[length]
            row = plan[np.searchsorted(keys, length << 50 | rank, side="right") - 1]
            nth = rank - row[:, 1]
            kept = batch.drop_columns(["_rank"])
            sequence, offset = row[:, 3] + nth // row[:, 2], row[:, 4] + nth % row[:, 2] * length
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(sequence), pa.array(offset)], [*kept.schema.names, "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "_rank").mapInArrow(place, PLACED)
