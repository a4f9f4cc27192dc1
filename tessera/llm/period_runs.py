"""Periodic runs of words: stretches that repeat with a smallest period, found by power-of-two names.

Karp-Miller-Rosenberg naming: two places have the same name at level k if the 2^k words from
each on are equal; a name at level k + 1 is a pair of names of level k, numbered by sorting. No hashes
and no suffixes are involved, so equality is exact. How far two places agree, forwards or
backwards, follows from the names in descending levels.

A run of period p matches itself p words on over at least p words, and so holds a whole block of 2^k words at a
multiple of 2^k, for the k with 2^(k+1) - 1 <= p < 2^(k+2) - 1. Only such blocks are compared with what lies p words on, for all
p of a level at once; each match is a candidate that is extended both ways. A stretch found with several periods
keeps the smallest. Texts of a slice are laid end to end, longest first, with a name that occurs once between them.

Defined results: null and wordless texts have no words and no runs; a null id counts as the empty text for its checksum;
repeated rows repeat; an empty table gives none. Rows are independent of each other, so nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._words import NOT_SPACE, text_slices

#: A run has at least so many words, and two periods.
LEAST_WORDS = 12
#: Comparisons of blocks that are held at once.
AT_ONCE = 1 << 22

RESULT = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def power_names(symbols: np.ndarray) -> list[np.ndarray]:
    """At level k the name of the 2^k symbols from each place on, -1 if they occur there only; up to the last level with any repeat. Symbols below 0 equal nothing."""
    n = len(symbols)
    names = np.full(n, -1, np.int32)
    real = symbols >= 0
    if real.any():
        names[real] = np.where(np.bincount(symbols[real])[symbols[real]] > 1, symbols[real], -1)
    levels, width = [], 1
    while (names >= 0).any():
        levels.append(names)
        at = np.flatnonzero(names[: max(0, n - width)] >= 0)
        at = at[names[at + width] >= 0]
        pairs = names[at].astype(np.int64) << 32 | names[at + width]
        _, name, count = np.unique(pairs, return_inverse=True, return_counts=True)
        names = np.full(n, -1, np.int32)
        names[at] = np.where(count[name] > 1, name, -1)
        width *= 2
    return levels


def _agree(levels: list[np.ndarray], at: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and end place of the stretch around ``at`` over which each word equals that ``period`` words on.

    No level above the last has a repeat, so each level counts once at most.
    """
    first, end = at.copy(), at.copy()
    for k in reversed(range(len(levels))):
        names, width = levels[k], 1 << k
        last = len(names) - 1
        here, there = names[np.minimum(end, last)], names[np.minimum(end + period, last)]
        end += np.where((end + period <= last) & (here >= 0) & (here == there), width, 0)
        before = np.maximum(first - width, 0)
        here, there = names[before], names[np.minimum(before + period, last)]
        first -= np.where((first >= width) & (here >= 0) & (here == there), width, 0)
    return first, end


def _candidates(names: np.ndarray, width: int, periods: range) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period) of blocks of ``width`` at its multiples that equal the block a period on; of a chain of them the first."""
    padded = np.concatenate([names, np.full(periods.stop + width, -2, np.int32)])
    own = names[::width]
    ahead = np.lib.stride_tricks.sliding_window_view(padded[periods.start :], len(periods))[::width]
    blocks = np.flatnonzero(own >= 0)
    step = max(1, AT_ONCE // len(periods))
    for lo in range(0, len(blocks), step):
        some = blocks[lo : lo + step]
        same = ahead[some] == own[some, None]
        first = same.copy()
        first[1:][np.diff(some) == 1] &= ~same[:-1][np.diff(some) == 1]
        block, period = np.nonzero(first)
        yield some[block] * width, period + periods.start


def find_runs(symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of all runs, by text, start and period.

    symbols: the words of all texts in order, equal if and only if the words are; lengths: the words of each text.
    """
    order = np.argsort(-lengths, kind="stable")
    opens = np.concatenate([[0], np.cumsum(lengths)])
    places = np.concatenate([[0], np.cumsum(lengths[order] + 1)])
    laid = np.full(places[-1], -1, np.int64)
    for place, text in zip(places.tolist(), order.tolist(), strict=False):
        laid[place : place + lengths[text]] = symbols[opens[text] : opens[text + 1]]
    levels = power_names(laid)
    found = [(np.zeros(0, np.int64),) * 3]
    for k in range(1, len(levels)):
        # Level 1 also serves the periods that are too short for its rule: their runs have LEAST_WORDS words.
        periods = range(1 if k == 1 else (2 << k) - 1, (4 << k) - 1)
        # Texts in order of length: those that are long enough come first.
        enough = places[np.searchsorted(-lengths[order], -max(LEAST_WORDS, 2 * periods.start), side="right")]
        if not enough:
            break
        for at, period in _candidates(levels[k][:enough], 1 << k, periods):
            first, end = _agree(levels, at, period)
            end += period
            long = end - first >= np.maximum(LEAST_WORDS, 2 * period)
            found.append((first[long], end[long], period[long]))
    first, end, period = (np.concatenate(x) for x in zip(*found, strict=True))
    by = np.lexsort((period, end, first))
    first, end, period = first[by], end[by], period[by]
    new = np.ones(len(first), bool)
    new[1:] = (first[1:] != first[:-1]) | (end[1:] != end[:-1])
    first, end, period = first[new], end[new], period[new]
    slot = np.searchsorted(places, first, side="right") - 1
    text, start = order[slot] if len(first) else slot, first - places[slot]
    by = np.lexsort((period, start, text))
    return text[by], start[by], (end - first)[by], period[by]


def planted_source(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which of its n words stands at each place, for a document whose tail is made periodic; None for the others."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    g = h // 10
    if h % 10 or not n:
        return None
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    places = np.arange(n)
    return np.where(places < a, places, a + (places - a) % p)


def _slice_rows(data: np.ndarray, bounds: np.ndarray, ids: list | None) -> Iterator[tuple]:
    """RESULT of each text of a slice; with ids, planted texts are changed first."""
    inside = NOT_SPACE.take(data)
    opens, shuts = np.ones(len(data), bool), np.ones(len(data), bool)
    opens[1:], shuts[:-1] = ~inside[:-1], ~inside[1:]
    opens[bounds[:-1][bounds[:-1] < len(data)]] = True
    shuts[bounds[1:][bounds[1:] > 0] - 1] = True
    starts, ends = np.flatnonzero(opens & inside), np.flatnonzero(shuts & inside) + 1
    edges = np.searchsorted(starts, bounds)
    lengths = np.diff(edges)
    # The words without the space between them, as one Arrow array: its dictionary numbers them exactly.
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[inside]))])
    source = np.arange(len(starts))
    for i, n in enumerate(lengths.tolist()) if ids is not None else ():
        planted = planted_source(ids[i], n)
        if planted is not None:
            source[edges[i] : edges[i + 1]] = edges[i] + planted
    symbols = pc.dictionary_encode(words).indices.to_numpy().astype(np.int64)[source]
    text, start, length, period = find_runs(symbols, lengths)
    cover = np.zeros(len(starts) + 1, np.int64)
    np.add.at(cover, edges[text] + start + period, 1)
    np.add.at(cover, edges[text] + start + length, -1)
    kept = np.cumsum(cover)[:-1] == 0
    stay = np.flatnonzero(kept)
    texts = pa.LargeListArray.from_arrays(pa.array(np.searchsorted(stay, edges)), words.take(pa.array(source[stay])))
    left = pc.binary_join(texts, pa.scalar(b" ", pa.large_binary())).to_pylist()
    runs = np.searchsorted(text, np.arange(len(lengths) + 1))
    for i in range(len(lengths)):
        a, b = runs[i], runs[i + 1]
        listed = hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in zip(start[a:b].tolist(), length[a:b].tolist(), period[a:b].tolist(), strict=True)).encode()).hexdigest()
        collapsed = hashlib.sha256(left[i]).hexdigest()
        best = (None,) * 4
        if b > a:
            # The first of the longest: runs come by start and period.
            k = a + int(np.argmax(length[a:b]))
            best = (int(start[k]), int(length[k]), int(period[k]), int(1000 * length[k] // period[k]))
        yield (int(b - a), *best, listed, collapsed)


def runs_of_texts(docs: DataFrame, planted: bool = False) -> DataFrame:
    """doc_id and RESULT of each row of docs (doc_id, text); other columns don't pass.

    n_runs; start, length, period and floor(1000 * length / period) of the longest run; the checksum of the list of all runs; that of the text
    without what repeats (each word that some run contains after its first period), its words joined by one space.
    planted: rows whose id's checksum ends in 0 are searched after their tail has been made periodic, see planted_source().
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column("doc_id").to_pylist(), []
            for lo, hi, data, bounds in text_slices(pa.Table.from_batches([batch])):
                rows += _slice_rows(data, bounds, ids[lo:hi] if planted else None)
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", *(c.split()[0] for c in RESULT.split(", "))])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(search, f"doc_id long, {RESULT}")
