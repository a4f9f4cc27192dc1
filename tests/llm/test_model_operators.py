"""Language-model scores, whitening and periodic runs against brute force and planted cases."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import lm_scoring, period_runs, whitening
from tests.llm.test_operators import words_of

# ---- 11 language-model scores


def folded(text: str | None) -> list[bytes]:
    return [*words_of((text or "").translate({c: c + 32 for c in range(65, 91)})), b"\n"]


def scored(docs, **options) -> list[dict]:
    return [r.asDict() for r in lm_scoring.score(lm_scoring.learn(docs, ~lm_scoring.held_out(F.col("doc_id")), **options)).collect()]


def is_held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


@pytest.fixture(scope="module")
def scores(docs):
    return scored(docs)


def test_base_scores_are_exact(scores, rows):
    counts = Counter(w for i, text, *_ in rows if not is_held_out(i) for w in folded(text))
    n, v = sum(counts.values()), len(counts)
    wanted = Counter()
    for i, text, *_ in rows:
        ws = folded(text)
        wanted[i, text, len(ws), sum(counts[w] > 0 for w in ws), f"{sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws):.9g}"] += 1
    assert Counter((r["doc_id"], r["text"], r["n_tokens"], r["n_known"], f"{r['base_score']:.9g}") for r in scores) == wanted


def test_scores_follow_the_counts_of_pairs(docs, scores, rows):
    """A plain model over exact pair counts, rounded down to their levels, gives the scores but for a few false members."""
    learn = lm_scoring.learn(docs, ~lm_scoring.held_out(F.col("doc_id")))
    counts, pairs, texts = Counter(), Counter(), [(i, folded(t)) for i, t, *_ in rows]
    for i, ws in texts:
        if not is_held_out(i):
            counts.update(ws)
            pairs.update(zip([b"", *ws], ws, strict=False))
    counts[b""] = counts[b"\n"]
    n = sum(counts.values()) - counts[b""]
    v = len(counts) - 1
    floor = lambda c: int(lm_scoring.LEAST[lm_scoring.level_of(np.array([c]))[0] - 1]) if c else 0
    near, found = 0, defaultdict(list)
    for r in scores:
        found[r["doc_id"]].append(r["score"])
    for i, ws in texts:
        total = 0.0
        for h, w in zip([b"", *ws], ws, strict=False):
            weight = learn.weights[lm_scoring.level_of(np.array([counts[h]]))[0]]
            total += math.log10((1 - weight) * (counts[w] + 1) / (n + v + 1) + weight * floor(pairs[h, w]) / max(1, counts[h]))
        near += any(abs(total - s) < 1e-6 + 0.01 * abs(total) for s in found[i])
        assert all(s >= total - 1e-6 for s in found[i]) or len(found[i]) > 1
    assert near > 0.95 * len(rows)


def test_large_filters_stay_where_they_are(docs, scores):
    key = lambda r: repr((r["doc_id"], r["text"], r["score"]))
    assert sorted(map(key, scored(docs, most_broadcast=0))) == sorted(map(key, scores))


def test_scores_tell_order_from_disorder(spark):
    rng = random.Random(3)
    sentence = "the quick brown fox jumps over the lazy dog while seven small cats watch from an old garden wall".split()
    texts = []
    for i in range(300):
        words = sentence * 4
        if i % 3 == 0:
            rng.shuffle(words)
        texts.append((i, " ".join(words)))
    found = {r["doc_id"]: r for r in scored(spark.createDataFrame(texts, "doc_id long, text string"))}
    ordered, mixed = ([r for i, r in found.items() if is_held_out(i) and (i % 3 == 0) == m] for m in (False, True))
    assert min(r["score"] for r in ordered) > max(r["score"] for r in mixed)
    assert all(r["score"] > r["base_score"] + 20 for r in ordered)


def test_levels_and_filter():
    counts = np.array([0, 1, 2, 3, 4, 5, 6, 1000, 2**40])
    levels = lm_scoring.level_of(counts)
    assert levels[0] == 0 and all(levels[1:] == [1 + math.floor(math.log(c, 1.5) + 1e-9) for c in counts[1:].tolist()])
    rng = np.random.default_rng(1)
    keys, held = np.unique(rng.integers(0, 1 << 40, 20_000).astype(np.uint64)), 0
    levels = rng.integers(1, 12, len(keys))
    filter_ = lm_scoring.Filter.of([(3, lm_scoring.make_segment(keys, levels).tobytes())], 5)
    found = filter_.levels(np.full(len(keys), 3), keys, np.full(len(keys), 99))
    assert (found >= levels).all() and (found == levels).mean() > 0.98
    others = rng.integers(1 << 40, 1 << 41, 20_000).astype(np.uint64)
    held = filter_.levels(np.full(len(others), 3), others, np.full(len(others), 99))
    assert (held > 0).mean() < 0.01 and not filter_.levels(np.full(9, 2), keys[:9], np.full(9, 99)).any()


def test_scores_without_rows_or_teachers(spark, none):
    assert scored(none) == []
    docs = spark.createDataFrame([(1, "a b", "x"), (None, None, None)], "doc_id long, text string, Score string")
    found = lm_scoring.score(lm_scoring.learn(docs, F.lit(None).cast("boolean")))
    rows = {r["doc_id"]: r for r in found.collect()}
    assert found.columns == ["text", "doc_id", "n_tokens", "n_known", "base_score", "score"]
    assert rows[1]["score"] == rows[1]["base_score"] == 0.0 and rows[1]["n_tokens"] == 3 and rows[None]["n_tokens"] == 1 and rows[1]["n_known"] == 0


def test_scores_keep_other_columns(docs, rows):
    clash = docs.select("doc_id", "text", F.lit(7).alias("chunk"), F.lit("x").alias("row"), F.lit(True).alias("learn"), F.lit(1).alias("kind"))
    found = lm_scoring.score(lm_scoring.learn(clash, F.lit(True)))
    assert found.columns == ["text", "doc_id", "chunk", "row", "learn", "kind", *lm_scoring.ADDED]
    assert found.where("chunk = 7 and row = 'x' and learn and kind = 1").count() == len(rows)


# ---- 12 whitening


def reference_whitening(vectors: list, top: int = 4):
    x = [[math.floor(256 * float(c)) for c in v] for v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    distinct = np.array(sorted({tuple(v) for v in x}), np.int64)
    n, sums = len(distinct), distinct.sum(axis=0)
    centred = distinct - sums / n
    values, vecs = np.linalg.eigh(centred.T @ centred / n)
    return x, n, sums, values[::-1][:top], vecs[:, ::-1][:, :top], values.sum()


def test_whitening_matches_a_dense_solver(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(300, 12)) * np.geomspace(1, 0.02, 12) @ np.linalg.qr(rng.normal(size=(12, 12)))[0]
    vectors = base.tolist() + base[:50].tolist() + [None, [None] * 12, [math.nan] + [0.0] * 11, [math.inf] * 12, [0.0] * 12]
    rows = [(i, v, "x") for i, v in enumerate(vectors)] + [(7, vectors[7], "again"), (None, vectors[8], "none")]
    found = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>, n string").repartition(5)).collect()
    x, n, sums, values, vecs, trace = reference_whitening(vectors)
    assert len(found) == 4 * (len(x) + 2)
    ids = [i for i, v in enumerate(vectors) if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    by = {(r["vec_id"], r["component"]): r for r in found}
    white = (np.array(x) - sums / n) @ vecs / np.sqrt(values)
    for c in range(4):
        got = np.array([by[i, c + 1]["whitened"] for i in ids])
        assert np.allclose(got, white[:, c] * np.sign((got * white[:, c]).sum()), atol=1e-9)
        assert by[0, c + 1]["explained"] == pytest.approx(values[c] / trace, rel=1e-10)
    for k, i in enumerate(ids):
        assert by[i, 1]["deviation"] == sum((n * a - int(s)) ** 2 for a, s in zip(x[k], sums, strict=True)) and by[i, 2]["n"] == n
    assert {r["identity_error"] for r in found} == {found[0]["identity_error"]} and found[0]["identity_error"] < 1e-10
    assert by[None, 1]["whitened"] == by[8, 1]["whitened"]


def test_jacobi_is_accurate_for_small_eigenvalues():
    rng = np.random.default_rng(5)
    for d in (1, 2, 3, 7, 16, 33):
        q = np.linalg.qr(rng.normal(size=(d, d)))[0]
        a = q @ np.diag(np.linspace(1, 2, d)) @ q.T
        scale = np.geomspace(1, 1e-9, d)
        values, vectors = whitening.jacobi(scale[:, None] * a * scale)
        assert np.allclose(vectors.T @ vectors, np.eye(d), atol=1e-13) and (np.diff(values) <= 0).all()
        # The scaled matrix has eigenvalues down to 1e-18 of the largest; its inverse tells the least one well.
        inverse = np.linalg.inv(a) / scale[:, None] / scale
        assert 1 / values[-1] == pytest.approx(np.linalg.eigvalsh(inverse / inverse.max())[-1] * inverse.max(), rel=1e-9)


def test_whitening_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], schema)).count() == 0
    one = whitening.whiten(spark.createDataFrame([(1, [0.5, 0.25])] * 3, schema)).collect()
    assert len(one) == 6 and {(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one} == {(1, 0, None, None, 0.0)}
    ragged = whitening.whiten(spark.createDataFrame([(1, [0.5]), (2, [0.0, 0.5]), (3, [0.5, 0.0]), (4, [1e30, -1e30])], schema)).collect()
    assert {r["vec_id"] for r in ragged} == {2, 3, 4} and {r["deviation"] for r in ragged} == {None}
    flat = {(r["vec_id"], r["component"]): r for r in whitening.whiten(spark.createDataFrame([(i, [float(i), 0.0, 1.0]) for i in range(5)], schema)).collect()}
    assert flat[0, 1]["explained"] == 1.0 and flat[0, 2]["whitened"] is None and abs(flat[4, 1]["whitened"]) == pytest.approx(2**0.5)


# ---- 13 periodic runs


def brute_runs(words: list) -> list[tuple]:
    """(start, length, period), from the definition."""
    n, out = len(words), []
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            length = j + p - i
            if length >= max(12, 2 * p) and not any(all(words[x] == words[x + q] for x in range(i, j + p - q)) for q in range(1, p)):
                out.append((i, length, p))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text) -> tuple:
    words = words_of(text)
    n, h = len(words), zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    listed, kept = "".join(f"{s},{m},{q}\n" for s, m, q in runs), b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_runs_of_random_words_are_exact():
    rng = random.Random(9)
    texts = []
    for _ in range(300):
        alphabet, words = "abcdefgh"[: rng.randrange(1, 9)], []
        while len(words) < rng.randrange(0, 90):
            piece = [rng.choice(alphabet) for _ in range(rng.randrange(1, 12))]
            words += (piece * rng.randrange(1, 6))[: rng.randrange(1, 60)]
        texts.append(words)
    symbols = np.array([ord(w) - 97 for t in texts for w in t], np.int64)
    text, start, length, period = (x.tolist() for x in period_runs.find_runs(symbols, np.array([len(t) for t in texts])))
    found = defaultdict(list)
    for row in zip(text, start, length, period, strict=True):
        found[row[0]].append(row[1:])
    for i, words in enumerate(texts):
        assert found[i] == brute_runs(words), words


def test_runs_of_documents(spark, docs, rows):
    repeats = [(500 + i, " ".join((["a", "b", "c"] * 9)[:n] + ["d"] * m), "en", "s", 0) for i, (n, m) in enumerate([(11, 0), (12, 0), (27, 11), (27, 12), (0, 1), (24, 30)])]
    found = period_runs.runs_of_texts(docs.select("doc_id", "text", "source", F.lit(1).alias("n_runs")).unionAll(spark.createDataFrame(repeats, docs.schema).select("doc_id", "text", "source", F.lit(1))), planted=True).collect()
    wanted = Counter(brute_row(r[0], r[1]) for r in [*rows, *repeats] if r[0] != 407)
    assert Counter(tuple(r) for r in found if r["doc_id"] != 407) == wanted
    assert len(found) == len(rows) + len(repeats) and sum(n for r, n in wanted.items() if r[1]) > 5


def test_runs_of_long_texts():
    words = np.tile(np.arange(1000), 300)
    assert [x.tolist() for x in period_runs.find_runs(words, np.array([len(words)]))] == [[0], [0], [300_000], [1000]]
    assert [x.tolist() for x in period_runs.find_runs(np.zeros(200_000, np.int64), np.array([200_000]))] == [[0], [0], [200_000], [1]]


def test_runs_of_nothing(none):
    assert period_runs.runs_of_texts(none).count() == 0
