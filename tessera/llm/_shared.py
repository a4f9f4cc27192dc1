"""Which hashes occur in more than one chunk of the corpus, without any task that sees them all.

The corpus is dealt into chunks by a hash of the id. A chunk sends each of its
distinct hashes once, packed by hash bucket, so that even a hash which every
document has costs one entry per chunk; a bucket answers each chunk with those
of its hashes that matter to it. The texts are shuffled once: every step groups the same
frame by the same key, so Spark reuses its exchange.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import partitions
from tessera.llm._words import as_binaries, give_back, joined

#: Bytes of text in a partition of chunks, and chunks in a partition: a chunk is what one call of Python sees of the texts.
PARTITION_BYTES, CHUNKS_A_PARTITION = 24 << 20, 2

SENT = "bucket int, chunk int, hashes binary, firsts binary"
ANSWER = "chunk int, level int, hashes binary"


def in_chunks(docs: DataFrame) -> tuple[DataFrame, int]:
    """docs with ``chunk`` in front, and the number of partitions that hold them, which follows the bytes of the texts; null ids are dealt by their text."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(partitions(docs.sparkSession), -(-size // PARTITION_BYTES))
    deal = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")).otherwise(F.xxhash64("text"))
    chunk = F.pmod(deal, F.lit(n * CHUNKS_A_PARTITION)).cast("int").alias("chunk")
    return docs.select(chunk, *docs.columns).repartition(n, "chunk"), n


def sent(chunk: int, buckets: np.ndarray, hashes: pa.Array, firsts: pa.Array) -> pa.Table:
    n = len(buckets)
    return pa.table({"bucket": pa.array(buckets, pa.int32()), "chunk": pa.array(np.full(n, chunk), pa.int32()), "hashes": hashes, "firsts": firsts})


def answered(rows: DataFrame, buckets: int, level: int, pick: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """Each bucket's answers, from so many buckets. pick(hashes, firsts, starts of runs of equal hashes) marks, over hashes in order, what goes back to its sender."""

    def answer(table: pa.Table) -> pa.Table:
        give_back()
        hashes, firsts = joined(table.column("hashes")), joined(table.column("firsts"), np.int64)
        counts = np.array([len(b) // 8 for b in table.column("hashes").to_pylist()], np.int64)
        order = np.argsort(hashes, kind="stable")
        ordered = hashes[order]
        starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
        keep = np.zeros(len(hashes), bool)
        keep[order] = pick(ordered, firsts[order] if len(firsts) else firsts, starts)
        back = np.add.reduceat(keep.astype(np.int64), np.concatenate([[0], np.cumsum(counts)[:-1]])) if len(hashes) else counts * 0
        full = back > 0
        chunks = table.column("chunk").to_numpy()[full]
        return pa.table({"chunk": pa.array(chunks, pa.int32()), "level": pa.array(np.full(len(chunks), level), pa.int32()), "hashes": as_binaries(hashes[keep], back[full])})

    return rows.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(answer, ANSWER)


def in_several(ordered: np.ndarray, firsts: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hashes that more than one chunk has sent."""
    runs = np.diff([*starts, len(ordered)])
    return np.repeat(runs > 1, runs)


def first_elsewhere(ordered: np.ndarray, firsts: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hashes whose first document over all chunks comes before the sender's own first."""
    runs = np.diff([*starts, len(ordered)])
    return np.repeat(np.minimum.reduceat(firsts, starts), runs) < firsts if len(ordered) else np.zeros(0, bool)


def answers_of(table: pa.Table, level: int) -> np.ndarray:
    """The sorted hashes that a chunk has got back at a level."""
    return np.sort(joined(table.filter(pc.equal(table.column("level"), level)).column("hashes"))) if table.num_rows else np.zeros(0, np.uint64)
