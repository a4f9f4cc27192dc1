"""Approximate nearest vectors by an inverted file: lists around centroids, of which a query probes the nearest.

Centroids are fitted on a bounded sample (SAMPLE rows, chosen by a hash of their ids), and so is the number of lists to probe: as many as find TARGET of the nearest neighbours within the
sample. Every row is put into the list of its nearest centroid. A query meets only the
rows of the lists it probes, by a join on the list; large lists are cut into blocks, so neither a query nor a list is one task. What is broadcast is MOST_LISTS centroids at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.retrieval import matrix, top_k, unit

SAMPLE, MOST_LISTS, ROUNDS = 20_000, 4096, 10
#: The share of the sample's neighbours to find, and how many of its rows look for theirs.
TARGET, ASKED = 0.93, 500
#: Rows of a list that meet a query's vector in one task.
BLOCK = 4096


@dataclass
class Index:
    """Unit centroids, and how many of their lists a query probes."""

    centroids: np.ndarray
    probes: int


def fit_index(corpus: DataFrame, k: int, sample: int = SAMPLE, most: int = MOST_LISTS, target: float = TARGET) -> Index:
    """About as many lists as the square root of the number of rows of a corpus (chunk_id, vector); the same in every run."""
    n = corpus.count()
    if not n:
        return Index(np.zeros((0, 0)), 0)
    part = F.pmod(F.xxhash64("chunk_id"), F.lit(1 << 30)) < F.lit(int(min(1.0, sample / n) * (1 << 30)))
    held = corpus.where(part).orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(sample).select("vector").toArrow()
    if not held.num_rows:
        held = corpus.orderBy("chunk_id").limit(1).select("vector").toArrow()
    rows = unit(matrix(held))
    lists = max(1, min(most, round(n**0.5), len(rows)))
    centroids = rows[np.random.default_rng(7).permutation(len(rows))[:lists]]
    for _ in range(ROUNDS):
        nearest = (rows @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, rows)
        empty = np.bincount(nearest, minlength=lists) == 0
        sums[empty] = centroids[empty]
        centroids = unit(sums)
    return Index(centroids, _probes(rows, centroids, k, target))


def _probes(rows: np.ndarray, centroids: np.ndarray, k: int, target: float) -> int:
    """How many lists have to be probed to find so large a share of the k nearest other rows."""
    asked, k = rows[:ASKED], min(k, len(rows) - 1)
    if k < 1:
        return 1
    scores = asked @ rows.T
    scores[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    near = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    places = np.argsort(np.argsort(-(asked @ centroids.T), axis=1), axis=1)
    needed = np.take_along_axis(places, (rows @ centroids.T).argmax(axis=1)[near], axis=1)
    return int(np.quantile(needed, target)) + 1


def assign(rows: DataFrame, key: str, centroids: np.ndarray, probes: int = 1) -> DataFrame:
    """rows (key, vector, ...) with ``list``: one row for each of the ``probes`` nearest centroids."""
    held = rows.sparkSession.sparkContext.broadcast(centroids)
    probes = min(probes, len(centroids))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = unit(matrix(pa.Table.from_batches([batch]))) @ held.value.T
            best = np.argpartition(-scores, probes - 1, axis=1)[:, :probes]
            at = pa.array(np.repeat(np.arange(len(scores)), probes))
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns), pa.array(best.ravel().astype(np.int32))], [*batch.schema.names, "list"])

    return rows.mapInArrow(nearest, rows.withColumn("list", F.lit(0)).schema)


def ann_neighbours(corpus: DataFrame, queries: DataFrame, k: int, index: Index | None = None, drop_self: bool = False) -> DataFrame:
    """(query_id, chunk_id, rank, score): the best k by cosine among the rows of the lists that each query (query_id, vector) probes in a corpus (chunk_id, ord, vector)."""
    index = fit_index(corpus, k) if index is None else index
    centroids, probes = index.centroids, index.probes
    schema = "query_id long, chunk_id long, ord long, score double"
    if not len(centroids):
        return corpus.sparkSession.createDataFrame([], "query_id long, chunk_id long, rank int, score double")
    held = assign(corpus.select("chunk_id", "ord", "vector"), "chunk_id", centroids)
    # One row for each list, of which there are MOST_LISTS at most.
    sizes = held.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    held = held.join(F.broadcast(sizes), "list").select("list", F.pmod(F.xxhash64("chunk_id"), "blocks").cast("int").alias("block"), "chunk_id", "ord", "vector")
    asked = assign(queries.select("query_id", "vector"), "query_id", centroids, probes).join(F.broadcast(sizes), "list")
    asked = asked.select("list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "query_id", "vector")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        names, chunk, place = (t.column(c).to_numpy() for t, c in ((left, "query_id"), (right, "chunk_id"), (right, "ord")))
        if not len(names) or not len(chunk):
            return pa.table({c: pa.array([], t) for c, t in (("query_id", pa.int64()), ("chunk_id", pa.int64()), ("ord", pa.int64()), ("score", pa.float64()))})
        scores = np.round(unit(matrix(left)) @ unit(matrix(right)).T, 9)
        if drop_self:
            scores[names[:, None] == chunk[None, :]] = -np.inf
        order = np.lexsort((np.broadcast_to(place, scores.shape), -scores), axis=1)[:, :k]
        best = np.take_along_axis(scores, order, axis=1)
        real = best > -np.inf
        return pa.table({"query_id": np.repeat(names, order.shape[1])[real.ravel()], "chunk_id": chunk[order][real], "ord": place[order][real], "score": best[real]})

    found = asked.groupBy("list", "block").cogroup(held.groupBy("list", "block")).applyInArrow(search, schema)
    return top_k(found, k, [F.desc("score"), F.asc("ord")]).select("query_id", "chunk_id", "rank", "score")
