"""Token counts that follow edits: a segment tree of pre-tokens for each document.

A document is split into pre-tokens, which are encoded on their own. Blocks of pre-tokens are the leaves of a tree
of subtree sums (characters and tokens). An edit finds its blocks by
characters, re-splits them with the block before as context, and goes on until a pre-token starts
where an old block did; only those pre-tokens are encoded, and only the sums above
their blocks change.

Defined results: null text is the empty text with no tokens; a null list of edits has none; an edit's
places are cut to the text as it then is, a null replacement deletes, a null start is 0 and a null end the start; rows are independent
of each other, so repeated rows repeat; an empty table gives none. Other columns pass through.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_50k.tiktoken"
BLOCK, REMEMBERED = 32, 600_000
COUNTED = "n_tokens long, n_pretokens long, edited_tokens long, edited_chars long, n_edits int, reencoded long"


class PretokenCounts(dict):
    """Tokens of each pre-token; remembers a bounded number of them."""

    def __init__(self, path: str | None = None):
        import public_tokenizers
        import tiktoken

        with open(path or public_tokenizers.path(VOCABULARY), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(public_tokenizers.PATTERN)

    def __missing__(self, piece: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        self[piece] = n = len(self.encoding.encode_ordinary(piece))
        return n


class TokenTree:
    """One document's blocks of pre-tokens under a tree of sums."""

    def __init__(self, text: str, counts: PretokenCounts):
        self.counts, self.reencoded = counts, 0
        found = counts.pattern.findall(text)
        self.blocks = ["".join(found[i : i + BLOCK]) for i in range(0, len(found), BLOCK)] or [""]
        tokens = np.fromiter(map(counts.__getitem__, found), np.int64, len(found))
        self.size = 1 << (len(self.blocks) - 1).bit_length()
        self.n_pretokens = len(found)
        # Nodes from 1; the children of k are 2 k and 2 k + 1, the leaves start at size.
        self.sums = np.zeros((2 * self.size, 2), np.int64)
        if len(found):
            self.sums[self.size : self.size + len(self.blocks), 0] = np.add.reduceat(tokens, np.arange(0, len(found), BLOCK))
            self.sums[self.size : self.size + len(self.blocks), 1] = list(map(len, self.blocks))
        level = self.size
        while level > 1:
            self.sums[level // 2 : level] = self.sums[level : 2 * level : 2] + self.sums[level + 1 : 2 * level : 2]
            level //= 2

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 0])

    @property
    def chars(self) -> int:
        return int(self.sums[1, 1])

    def text(self) -> str:
        return "".join(self.blocks)

    def _find(self, char: int) -> tuple[int, int]:
        """The block that holds this character (the last one, for the end of the text), and where it starts."""
        node, before = 1, 0
        while node < self.size:
            node *= 2
            if char >= before + self.sums[node, 1] and self.sums[node + 1, 1]:
                before += int(self.sums[node, 1])
                node += 1
        return node - self.size, before

    def _set(self, block: int, text: str, tokens: int) -> None:
        self.blocks[block] = text
        node = block + self.size
        change = np.array([tokens, len(text)]) - self.sums[node]
        while node:
            self.sums[node] += change
            node //= 2

    def edit(self, start: int, end: int, replacement: str) -> None:
        """Put replacement in the place of characters start to end."""
        start = max(0, min(start, self.chars))
        end = max(start, min(end, self.chars))
        (first, at), (last, _) = self._find(start), self._find(end)
        before = first - 1
        while before >= 0 and not self.blocks[before]:
            before -= 1
        if before >= 0:
            first, at = before, at - len(self.blocks[before])
        region = "".join(self.blocks[first : last + 1])
        region = region[: start - at] + replacement + region[end - at :]
        following = last + 1
        while True:
            while following < len(self.blocks) and not self.blocks[following]:
                following += 1
            if following >= len(self.blocks):
                found = self.counts.pattern.findall(region)
                break
            # A pre-token that starts where the next block does: from there on nothing has changed.
            longer, found, reached = region + self.blocks[following], [], 0
            for match in self.counts.pattern.finditer(longer):
                if match.start() >= len(region):
                    break
                found.append(match.group())
                reached = match.end()
            if reached == len(region):
                break
            region, following = longer, following + 1
        self.reencoded += len(found)
        self._set(first, region, sum(map(self.counts.__getitem__, found)))
        for block in range(first + 1, min(following, len(self.blocks))):
            if self.blocks[block]:
                self._set(block, "", 0)


def count_with_edits(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs with token counts before and after its column ``edits`` (an array of start, end, replacement), applied in order; they replace columns of their names, in any case."""
    names = [c.split()[0] for c in COUNTED.split(", ")]
    rows = docs.drop(*names)
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = PretokenCounts(path)
        for batch in batches:
            out = []
            for text, edits in zip(batch.column("text").to_pylist(), batch.column("edits").to_pylist(), strict=True):
                tree = TokenTree(text or "", counts)
                before = tree.tokens
                for e in edits or ():
                    start = e["start"] or 0
                    tree.edit(start, start if e["end"] is None else e["end"], e["replacement"] or "")
                out.append((before, tree.n_pretokens, tree.tokens, tree.chars, len(edits or ()), tree.reencoded))
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *names])

    schema = rows
    for column in COUNTED.split(", "):
        name, kind = column.split()
        schema = schema.withColumn(name, F.lit(0).cast(kind))
    return rows.mapInArrow(count, schema.schema)


def sample_edits(text: str = "text"):
    """Three edits of each text: a note in front, a phrase in the middle third, and a deletion at the middle."""
    n = F.coalesce(F.length(text), F.lit(0))

    def edit(start, end, replacement: str):
        return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(replacement).alias("replacement"))

    return F.array(edit(F.lit(0), F.lit(0), "Note: "), edit(n / 3, n / 3 + 12, " revised passage"), edit(n / 2, n / 2 + 8, ""))
