"""Media columns: payloads stored as 8-bit greyscale PNG in binary columns.

The encoder writes signature, IHDR, IDAT (zlib) and IEND with their checksums;
the reader checks every chunk's checksum, inflates and undoes the row filters
with numpy. A cosine transform of the reduced picture gives a 64-bit hash from its low frequencies.

Defined results: null text is the empty text; every payload is padded with
bytes 255 to a positive multiple of 576, so there is no empty picture; damaged
bytes raise. Rows are independent of each other: repeated rows repeat, an empty table gives none.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

CELL, PAD = 24, 255
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: The side of the reduced picture and of its corner of low frequencies.
REDUCED, LOW = 32, 8


def payload_of(text: bytes) -> bytes:
    return text + bytes([PAD]) * (-len(text) % CELL**2 if text else CELL**2)


def picture_size(n: int) -> tuple[int, int]:
    """Height and width, multiples of 24, of n samples; as near to a square as n's factors allow."""
    cells = n // CELL**2
    side = next(a for a in range(int(cells**0.5), 0, -1) if cells % a == 0)
    return CELL * (cells // side), CELL * side


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def encode_png(payload: bytes) -> bytes:
    """Each row takes the filter (none, left, up) with the least sum of signed differences."""
    height, width = picture_size(len(payload))
    rows = np.frombuffer(payload, np.uint8).reshape(height, width)
    left, up = rows.copy(), rows.copy()
    left[:, 1:] -= rows[:, :-1]
    up[1:] -= rows[:-1]
    forms = np.stack([rows, left, up])
    best = np.abs(forms.view(np.int8).astype(np.int16)).sum(axis=2).argmin(axis=0)
    lines = np.empty((height, width + 1), np.uint8)
    lines[:, 0], lines[:, 1:] = best, forms[best, np.arange(height)]
    header = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def _predict(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
    return np.where((pa_ <= pb) & (pa_ <= pc), a, np.where(pb <= pc, b, c))


def unfilter(kinds: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Undo the five row filters. Rows of one kind that follow each other are undone together where that is a running sum."""
    out = np.empty_like(lines)
    height, width = lines.shape
    edges = [0, *(np.flatnonzero(kinds[1:] != kinds[:-1]) + 1), height]
    for lo, hi in zip(edges, edges[1:], strict=False):
        kind, above = kinds[lo], out[lo - 1] if lo else np.zeros(width, np.uint8)
        if kind == 0:
            out[lo:hi] = lines[lo:hi]
        elif kind == 1:
            out[lo:hi] = np.cumsum(lines[lo:hi], axis=1, dtype=np.uint8)
        elif kind == 2:
            out[lo:hi] = np.cumsum(lines[lo:hi], axis=0, dtype=np.uint8) + above
        elif kind in (3, 4):
            for y in range(lo, hi):
                up = (out[y - 1] if y else np.zeros(width, np.uint8)).astype(np.int16)
                left = corner = np.int16(0)
                for x in range(width):
                    guess = (left + up[x]) >> 1 if kind == 3 else _predict(left, up[x], corner)
                    left, corner = np.int16((int(lines[y, x]) + int(guess)) & 255), up[x]
                    out[y, x] = left
        else:
            raise ValueError(f"row filter {kind}")
    return out


def decode_png(data: bytes) -> np.ndarray:
    """The samples of an 8-bit greyscale picture; raises if a checksum or the header is wrong."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, header, body, ended = 8, None, [], False
    while at < len(data) and not ended:
        (n,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        content = data[at + 8 : at + 8 + n]
        if len(content) < n or struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(content, zlib.crc32(kind)):
            raise ValueError(f"checksum of {kind!r}")
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", content)
        elif kind == b"IDAT":
            body.append(content)
        ended, at = kind == b"IEND", at + 12 + n
    if header is None or not ended or header[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not a whole 8-bit greyscale picture")
    width, height = header[:2]
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width + 1)
    return unfilter(lines[:, 0], lines[:, 1:])


_wave = np.cos(np.pi / REDUCED * np.outer(np.arange(LOW), np.arange(REDUCED) + 0.5))


def cosine_hash(samples: np.ndarray) -> bytes:
    """64 bits: which low frequencies of the picture, reduced to 32 by 32, lie above their median."""
    small = samples.astype(np.float64)
    for axis in (0, 1):
        n = small.shape[axis]
        edges = np.arange(REDUCED) * n // REDUCED
        width = np.maximum(np.diff([*edges, n]), 1)
        small = np.add.reduceat(small, edges, axis=axis) / (width[:, None] if axis == 0 else width)
    low = (_wave @ small @ _wave.T).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes()


def encode_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): every whole text as a picture in a binary column."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            media = [encode_png(payload_of(t)) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(encode, "doc_id long, n_bytes long, media binary")


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, cosine_hash binary"


def read_media(media: DataFrame) -> DataFrame:
    """What the stored pictures hold, from their bytes alone: digests of the payload, and the hash as a binary column."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data in batch.column("media").to_pylist():
                samples = decode_png(data)
                payload = samples.tobytes()
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), cosine_hash(samples)))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            found = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *found], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "cosine_hash"])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(read, FEATURES)
