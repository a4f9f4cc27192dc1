"""Words, windows and their hashes over the bytes of many texts at once."""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are hashed together; a longer text is hashed alone.
SLICE_BYTES = 1 << 20
LATE = np.int64(2**63 - 1)

NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Longer words are hashed one by one.
LONG_WORD = 256
_STEP = 0x9E3779B97F4A7C15
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix64's finish)."""
    x = x ^ x >> np.uint64(30)
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes from each start to its end: eight bytes at a time are mixed in, and the length."""
    lengths = ends - starts
    whole = np.zeros(len(data) // 8 + 2, np.uint64)
    whole.view(np.uint8)[: len(data)] = data

    def eight(at: np.ndarray, held: np.ndarray) -> np.ndarray:
        """The (at most eight) bytes held from each place on, as one number."""
        index, shift = at >> 3, ((at & 7) << 3).astype(np.uint64)
        value = whole[index] >> shift | np.where(shift > 0, whole[index + 1] << (np.uint64(64) - np.maximum(shift, np.uint64(1))), np.uint64(0))
        return value & _FIRST_BYTES[np.minimum(held, 8)]

    out = mixed(lengths.astype(np.uint64) * np.uint64(_STEP) ^ eight(starts, lengths))
    more = np.flatnonzero((lengths > 8) & (lengths <= LONG_WORD))
    for at in range(8, LONG_WORD, 8):
        if not len(more):
            break
        out[more] = mixed(out[more] * np.uint64(_STEP) ^ eight(starts[more] + at, lengths[more] - at))
        more = more[lengths[more] > at + 8]
    for k in np.flatnonzero(lengths > LONG_WORD).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    return out


class Words:
    """The words of some texts: where each starts and ends in ``data``, its text's number and its hash."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, fold: bool = False, word_bytes: np.ndarray | None = None):
        """bounds: n + 1 places in data; fold: A-Z count as a-z; word_bytes: which bytes make words (else all but white space)."""
        inside = (NOT_SPACE if word_bytes is None else word_bytes).take(data)
        opens, shuts = np.ones(len(data), bool), np.ones(len(data), bool)
        opens[1:], shuts[:-1] = ~inside[:-1], ~inside[1:]
        opens[bounds[:-1][bounds[:-1] < len(data)]] = True
        shuts[bounds[1:][bounds[1:] > 0] - 1] = True
        self.starts, self.ends = np.flatnonzero(opens & inside), np.flatnonzero(shuts & inside) + 1
        self.n_texts = len(bounds) - 1
        self.text = np.repeat(np.arange(self.n_texts), np.diff(np.searchsorted(self.starts, bounds)))
        self.hash = _hashed(np.frombuffer(data.tobytes().translate(LOWER), np.uint8) if fold else data, self.starts, self.ends)

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """The hash of the window of so many words that starts at each word, and whether it lies in one text."""
        n = max(0, len(self.hash) - length + 1)
        value = np.zeros(n, np.uint64)
        for k in range(length):
            value = value * np.uint64(_STEP) + self.hash[k : k + n]
        return mixed(value), self.text[:n] == self.text[length - 1 : length - 1 + n]


def give_back() -> None:
    """Return what freed objects have left behind to the system: Python workers are used again by other steps, beside the JVM."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def text_slices(table: pa.Table) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, bounds) of slices of the table's texts; null texts are empty."""
    give_back()
    column = pc.fill_null(table.column("text").cast(pa.large_binary()), b"").combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) and column.num_chunks else column
    if not len(column):
        return
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + SLICE_BYTES, side="right")) - 1)
        yield lo, hi, data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo]
        lo = hi


def keys_of(table: pa.Table) -> np.ndarray:
    """The doc_ids; a null one counts as later than all others."""
    return pc.fill_null(table.column("doc_id"), int(LATE)).to_numpy().astype(np.int64)


def among(values: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array."""
    if not len(held):
        return np.zeros(len(values), bool)
    return held[np.minimum(np.searchsorted(held, values), len(held) - 1)] == values


def joined(binaries: pa.ChunkedArray, kind=np.uint64) -> np.ndarray:
    return np.frombuffer(b"".join(binaries.to_pylist()), kind)


def as_binaries(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """One binary per count, of consecutive values."""
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64) * values.dtype.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def dealt(hashes: np.ndarray, buckets: int, *more: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
    """The buckets that have any of the hashes, and each array cut by bucket."""
    bucket = (hashes >> np.uint64(33)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    found, counts = np.unique(bucket, return_counts=True)
    return found.astype(np.int32), [as_binaries(a[order], counts) for a in (hashes, *more)]
