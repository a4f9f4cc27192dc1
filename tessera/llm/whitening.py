"""Whitening of embeddings by a cyclic Jacobi eigensolver.

Vectors become whole numbers, floor(256 * entry). Each distinct one counts once: the distinct list is made by a shuffle with partial aggregation,
so copies meet before they are sent, and is kept in the checkpoint folder. Tasks sum it exactly, then
add up the scatter of the centred vectors; the driver gets d sums and d * (d + 1) / 2 products, whatever the number of rows.
There Jacobi rotations go through all pairs of dimensions, half of them at a time in a round-robin order, until every off-diagonal
vanishes against its two diagonals; that keeps small eigenvalues accurate to their own size. The whitening matrix is broadcast and applied in one pass.

Defined results: rows whose vector is null, empty, or holds a null or non-finite entry are dropped, and so are vectors whose length is not
the most frequent one of the distinct list (ties: the longer); whole numbers beyond 2^52 count as 2^52; a deviation beyond a long is null. A component without variance
(below rounding of the largest) has whitened null; explained is null if no component has any. Equal rows get equal
results, null ids stay, other columns don't pass, an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import durable

SCALE, FARTHEST = 256.0, float(1 << 52)
EPSILON, MOST_SWEEPS = 2.0**-52, 60
RESULT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def _whole(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, whole numbers) of the usable vectors of an Arrow list column, one block for each length."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype(np.int64)
    values = column.flatten()
    gaps = np.concatenate([[0], np.cumsum(lengths)])
    entries = pc.fill_null(values, np.nan).to_numpy(zero_copy_only=False).astype(np.float64)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(entries))])
    usable = (lengths > 0) & (bad[gaps[1:]] == bad[gaps[:-1]])
    for d in np.unique(lengths[usable]).tolist():
        rows = np.flatnonzero(usable & (lengths == d))
        block = entries[gaps[rows][:, None] + np.arange(d)]
        with np.errstate(over="ignore"):
            yield rows, np.clip(np.floor(SCALE * block), -FARTHEST, FARTHEST).astype(np.int64)


def _packed(x: np.ndarray) -> list[bytes]:
    """Each vector in the fewest bytes an entry (1, 2, 4 or 8) that hold all its entries; the first byte says how many."""
    low, high = x.min(axis=1), x.max(axis=1)
    width = np.full(len(x), 8)
    for bits in (32, 16, 8):
        width[(low >= -(1 << bits - 1)) & (high < 1 << bits - 1)] = bits // 8
    out: list[bytes] = [b""] * len(x)
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        held, size = x[rows].astype(f"<i{w}").tobytes(), w * x.shape[1]
        for k, row in enumerate(rows.tolist()):
            out[row] = bytes([w]) + held[k * size : (k + 1) * size]
    return out


def _unpacked(column: pa.Array, d: int) -> np.ndarray:
    x = np.empty((len(column), d), np.int64)
    values = column.to_pylist()
    widths = np.array([v[0] for v in values], np.int64)
    for w in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == w)
        x[rows] = np.frombuffer(b"".join(values[r][1:] for r in rows.tolist()), f"<i{w}").reshape(-1, d)
    return x


def fit_list(rows: DataFrame, vector: str) -> DataFrame:
    """(d, x): each distinct vector of whole numbers once, packed."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x in _whole(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), x.shape[1], np.int32)), pa.array(_packed(x), pa.binary())], ["d", "x"])

    return durable(rows.select(F.col(vector).cast("array<double>").alias("vector")).mapInArrow(pack, "d int, x binary").distinct())


def _sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """How many vectors there are, and the exact sum of each dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * d
        for batch in batches:
            x = _unpacked(batch.column("x"), d)
            n += len(x)
            exact = len(x) == 0 or float(np.abs(x).max()) * len(x) < 2.0**62
            sums = [a + int(b) for a, b in zip(sums, (x if exact else x.astype(object)).sum(axis=0), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([*range(d), d], pa.int32()), pa.array([*sums, n], pa.decimal128(38, 0))], ["i", "v"])

    found = {r["i"]: int(r["v"]) for r in fit.mapInArrow(add, "i int, v decimal(38,0)").groupBy("i").agg(F.sum("v").alias("v")).collect()}
    return found.get(d, 0), [found.get(i, 0) for i in range(d)]


def _scatter(fit: DataFrame, mean: np.ndarray) -> np.ndarray:
    """The sums of products of the centred vectors."""
    d = len(mean)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            centred = _unpacked(batch.column("x"), d) - mean
            total += centred.T @ centred
        i, j = np.triu_indices(d)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["i", "j", "v"])

    out = np.zeros((d, d))
    for r in fit.mapInArrow(add, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["v"]
    return out


def _rounds(d: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """All pairs of d dimensions in d - 1 (or d) rounds of disjoint pairs: one stays, the others move round."""
    seats = list(range(d + d % 2))
    out = []
    for _ in range(len(seats) - 1):
        half = len(seats) // 2
        pairs = [(min(p), max(p)) for p in zip(seats[:half], reversed(seats[half:]), strict=True) if max(p) < d]
        out.append((np.array([p for p, _ in pairs]), np.array([q for _, q in pairs])))
        seats = [seats[0], seats[-1], *seats[1:-1]]
    return out


def jacobi(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues by falling size and unit eigenvectors (columns, the entry of the greatest size positive) of a symmetric matrix."""
    a, d = (matrix + matrix.T) / 2, len(matrix)
    vectors, floor = np.eye(d), EPSILON**2 * np.abs(np.trace(matrix))
    for _ in range(MOST_SWEEPS if d > 1 else 0):
        turned = False
        for p, q in _rounds(d):
            off, dp, dq = a[p, q], a[p, p], a[q, q]
            turn = np.abs(off) > np.maximum(EPSILON * np.sqrt(np.abs(dp * dq)), floor)
            if not turn.any():
                continue
            turned = True
            p, q, off, dp, dq = p[turn], q[turn], off[turn], dp[turn], dq[turn]
            theta = (dq - dp) / (2 * off)
            t = np.where(theta >= 0, 1.0, -1.0) / (np.abs(theta) + np.hypot(theta, 1.0))
            c = 1 / np.hypot(t, 1.0)
            s = t * c
            for m in (a, vectors):
                m[:, p], m[:, q] = c * m[:, p] - s * m[:, q], s * m[:, p] + c * m[:, q]
            a[p], a[q] = c[:, None] * a[p] - s[:, None] * a[q], s[:, None] * a[p] + c[:, None] * a[q]
            a[p, q] = a[q, p] = 0.0
            a[p, p], a[q, q] = dp - t * off, dq + t * off
        if not turned:
            break
    values = np.diag(a).copy()
    order = np.argsort(-values, kind="stable")
    vectors = vectors[:, order]
    signs = np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(d)] < 0, -1.0, 1.0) if d else np.ones(0)
    return values[order], vectors * signs


@dataclass
class Whitening:
    """n and sums of the fit list, the eigenvalues of its covariance and, for the first of them, the whitening matrix (NaN: no variance)."""

    n: int
    sums: list[int]
    values: np.ndarray
    matrix: np.ndarray

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def apply(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.matrix

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The exact sum of (n * x - sum)^2 over the dimensions."""
        reach = self.n * float(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)
        if reach * reach * x.shape[1] < 2.0**62:
            return ((self.n * x - np.array(self.sums, np.int64)) ** 2).sum(axis=1).tolist()
        exact = ((self.n * x.astype(object) - np.array(self.sums, object)) ** 2).sum(axis=1)
        return [int(v) if v < 1 << 63 else None for v in exact]


def fit(distinct: DataFrame, d: int, top: int = 4) -> Whitening:
    """Learn from a fit list of vectors of length d."""
    n, sums = _sums(distinct, d)
    covariance = _scatter(distinct, np.array([s / n for s in sums])) / n
    values, vectors = jacobi(covariance)
    held = values[:top]
    spread = np.where(held > d * EPSILON * max(held[0], 0.0), held, np.nan)
    return Whitening(n, sums, values, vectors[:, :top] / np.sqrt(spread))


def identity_error(distinct: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened fit list's covariance minus the identity, over components that vary; measured on the rows themselves."""
    d, k = model.matrix.shape
    live = np.flatnonzero(np.isfinite(model.matrix).all(axis=0)).tolist()
    if not live:
        return 0.0
    held = distinct.sparkSession.sparkContext.broadcast(model)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            white = held.value.apply(_unpacked(batch.column("x"), d))
            yield pa.RecordBatch.from_arrays([pa.array(white[:, c]) for c in range(k)], [f"w{c}" for c in range(k)])

    white = distinct.mapInArrow(project, ", ".join(f"w{c} double" for c in range(k)))
    found = white.agg(*(F.covar_pop(f"w{a}", f"w{b}").alias(f"c{a}_{b}") for a in live for b in live if a <= b)).first()
    return max(abs(found[f"c{a}_{b}"] - (a == b)) for a in live for b in live if a <= b)


def whiten(rows: DataFrame, vector: str = "embedding", key: str = "vec_id", top: int = 4) -> DataFrame:
    """key and RESULT of each usable row and each of the first ``top`` components (at most as many as there are dimensions)."""
    name = rows.schema[key].dataType.simpleString()
    schema = f"{key} {name}, {RESULT}"
    listed = fit_list(rows, vector)
    most = listed.groupBy("d").count().orderBy(F.desc("count"), F.desc("d")).first()
    if most is None:
        return rows.sparkSession.createDataFrame([], schema)
    d = most["d"]
    listed = listed.where(F.col("d") == d)
    model = fit(listed, d, top)
    trace, error = float(model.values.sum()), identity_error(listed, model)
    explained = [float(v) / trace if trace > 0 else None for v in np.maximum(model.values[:top], 0.0)]
    held = rows.sparkSession.sparkContext.broadcast(model)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        k = model.matrix.shape[1]
        for batch in batches:
            for at, x in _whole(batch.column(1)):
                if x.shape[1] != d:
                    continue
                white = model.apply(x).reshape(-1)
                n = len(at) * k
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(np.repeat(at, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))), pa.array(np.full(n, model.n, np.int64)),
                        pa.array(model.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(len(at)), k))), pa.array(white, from_pandas=True),
                        pa.array(explained * len(at), pa.float64()), pa.array(np.full(n, error)),
                    ], [key, *(c.split()[0] for c in RESULT.split(", "))],
                )

    return rows.select(F.col(key), F.col(vector).cast("array<double>").alias("_vector")).mapInArrow(project, schema)
