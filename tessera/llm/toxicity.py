"""Toxicity: class-conditional Kneser-Ney models of toxic and ordinary text.

For each class a bigram model backs off to that class's continuation counts, and
these to counts shared by both: in how many documents of the whole corpus each word occurs. An expression too rare to tell gets the
same backing in both models and does not speak for either. A text is compared by the two
models' log-likelihoods a word: over the whole text, over its most toxic run of words, and at its most
toxic word. A logistic curve over these, fitted on labelled rows that the counts
have not seen, turns them into a score.

All counts cover all rows: words and pairs of words of every labelled row but those set aside for the curve, documents of every row. The
tables that scoring needs are bounded: a word or pair stays if it is seen LEAST_COUNT times and makes up LEAST_SHARE of all that are counted in one of the classes (or in documents), so
that there are 1 / LEAST_SHARE of each and class at most, whatever the size of the corpus; others are left to backoff, equally in both classes.
Only the curve is fitted on a bounded sample: MOST_FIT rows set aside. Then all rows are scored in a single pass without a shuffle.

Words are known by 32 bits of their hash.

Defined results: null and wordless texts get the score of the bias alone; rows with equal ids
and texts get equal scores; contradictory labels of an id count as toxic; null labels are
left out; without labelled rows of both classes every score is 0 and an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import durable
from tessera.llm._words import Words, text_slices

MOST_FIT, FIT_EVERY = 12_000, 3
LEAST_COUNT, LEAST_SHARE, DISCOUNT = 5, 1e-6, 0.75
#: Words in the run whose likelihoods are compared.
RUN = 3
#: Labels are narrow rows; more than these are joined by a shuffle.
BROADCAST_LABELS = 1 << 20
#: Letters, digits and all non-ASCII bytes make words here.
_WORD_BYTES = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
#: Different words of documents after which a task hands on its counts; Spark adds them up.
COUNTED_AT_ONCE = 500_000
_COUNTED = "kind int, key long, n0 long, n1 long"
#: Kinds of counts: pairs of words, words of all documents; then words as contexts (and their followers) and as followers (of how many words).
_PAIR, _DOCUMENTS, _CONTEXT, _KINDS, _CONTINUATION = range(5)


def _words(data: np.ndarray, bounds: np.ndarray) -> tuple[Words, np.ndarray]:
    found = Words(data, bounds, fold=True, word_bytes=_WORD_BYTES)
    return found, found.hash >> np.uint64(32)


def _looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The values (rows) at the wanted keys, 0 where there is none."""
    if not len(keys):
        return np.zeros((len(wanted), *values.shape[1:]))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    out = values[at]
    out[keys[at] != wanted] = 0
    return out


@dataclass
class Model:
    """Of each kind of counts its sorted keys, a column of counts for each class, and the number of different keys and the sum."""

    keys: dict[int, np.ndarray] = field(default_factory=dict)
    counts: dict[int, np.ndarray] = field(default_factory=dict)
    distinct: dict[int, np.ndarray] = field(default_factory=dict)
    totals: dict[int, np.ndarray] = field(default_factory=dict)
    curve: np.ndarray | None = None

    def of(self, kind: int, wanted: np.ndarray) -> np.ndarray:
        return _looked_up(self.keys.get(kind, np.zeros(0, np.uint64)), self.counts.get(kind, np.zeros((0, 2))), wanted)

    def token_ratios(self, words: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """log P(word | toxic) - log P(word | ordinary) at each word; starts marks words that open a text."""
        zero = np.zeros(2)
        # Different words are far fewer than words.
        distinct, at = np.unique(words, return_inverse=True)
        documents, size = self.totals.get(_DOCUMENTS, zero)[0], self.distinct.get(_DOCUMENTS, zero)[0]
        backing = (self.of(_DOCUMENTS, distinct)[:, 0] + 1.0) / (documents + size + 1.0)
        total, kinds = self.totals.get(_CONTINUATION, zero), self.distinct.get(_CONTINUATION, zero)
        p = (np.maximum(self.of(_CONTINUATION, distinct) - DISCOUNT, 0) + DISCOUNT * kinds * backing[:, None]) / np.maximum(total, 1)
        held, followers, p = self.of(_CONTEXT, distinct)[at], self.of(_KINDS, distinct)[at], p[at]
        held, followers = np.concatenate([held[:1], held[:-1]]), np.concatenate([followers[:1], followers[:-1]])
        held[starts] = 0
        seen = self.of(_PAIR, np.concatenate([words[:1], words[:-1]]) << np.uint64(32) | words)
        with_context = (np.maximum(seen - DISCOUNT, 0) + DISCOUNT * followers * p) / np.maximum(held, 1)
        logs = np.log(np.where(held > 0, np.maximum(with_context, 1e-12), np.maximum(p, 1e-12)))
        return logs[:, 1] - logs[:, 0]

    def features(self, words: Words, hashes: np.ndarray) -> np.ndarray:
        """Of each text: bias, ratio a word, of its most toxic run and word, and its (log) length."""
        out = np.zeros((words.n_texts, 5))
        out[:, 0] = 1
        if not len(hashes):
            return out
        starts = np.concatenate([[True], words.text[1:] != words.text[:-1]])
        ratio = self.token_ratios(hashes, starts)
        first = np.flatnonzero(starts)
        texts, lengths = words.text[first], np.diff([*first, len(hashes)])
        out[texts, 1] = np.add.reduceat(ratio, first) / lengths
        sums = np.concatenate([[0], np.cumsum(ratio)])
        ends = np.minimum(np.arange(len(hashes)) + RUN, np.repeat(first + lengths, lengths))
        run = (sums[ends] - sums[:-1]) / (ends - np.arange(len(hashes)))
        out[texts, 2] = np.maximum.reduceat(run, first)
        out[texts, 3] = np.maximum.reduceat(ratio, first)
        out[texts, 4] = np.log1p(lengths)
        return out

    def scores(self, words: Words, hashes: np.ndarray) -> np.ndarray:
        """Of each text, 0 to 1; 0 if there was nothing to learn from."""
        return np.zeros(words.n_texts) if self.curve is None else 1 / (1 + np.exp(-self.features(words, hashes) @ self.curve))


def marked_labels(labels: DataFrame, most_fit: int = MOST_FIT) -> DataFrame:
    """(doc_id, toxic, role): role 0 is counted, 1 fits the curve, 2 neither: set aside beyond about ``most_fit`` rows. The same in every run."""
    rows = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    # Of two independent hashes the first sets rows aside, the second takes an even part of these.
    aside, n = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(FIT_EVERY)) == 0, max(1, rows.count())
    taken = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(int(min(1.0, most_fit * FIT_EVERY / n) * (1 << 30)))
    return durable(rows.select("doc_id", "toxic", F.when(~aside, 0).when(taken, 1).otherwise(2).alias("role")))


def _counts(texts: DataFrame) -> DataFrame:
    """_COUNTED: of texts (text, toxic; toxic null: only the documents of its words are counted)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(kind: int, key: np.ndarray, n0: np.ndarray, n1: np.ndarray) -> pa.RecordBatch:
            columns = [np.full(len(key), kind, np.int32), key.view(np.int64), n0.astype(np.int64), n1.astype(np.int64)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["kind", "key", "n0", "n1"])

        def summed(pairs: tuple[list, list], documents: list) -> Iterator[pa.RecordBatch]:
            none = [np.zeros(0, np.uint64)]
            key, n = np.unique(np.concatenate(documents or none), return_counts=True)
            yield rows(_DOCUMENTS, key, n, n * 0)
            for c, of_class in enumerate(pairs):
                key, n = np.unique(np.concatenate(of_class or none), return_counts=True)
                yield rows(_PAIR, key, n * (1 - c), n * c)

        for batch in batches:
            toxic = batch.column("toxic").fill_null(2).to_numpy(zero_copy_only=False)
            pairs, documents = ([], []), []
            for lo, _, data, bounds in text_slices(pa.Table.from_batches([batch])):
                words, hashes = _words(data, bounds)
                found = np.unique(words.text.astype(np.uint64) << np.uint64(32) | hashes) & np.uint64(0xFFFFFFFF)
                documents.append(found)
                label = toxic[lo + words.text[1:]]
                inside = words.text[1:] == words.text[:-1]
                for c in (0, 1):
                    of_class = np.flatnonzero(inside & (label == c))
                    pairs[c].append(hashes[of_class] << np.uint64(32) | hashes[of_class + 1])
                if sum(map(len, documents)) >= COUNTED_AT_ONCE:
                    yield from summed(pairs, documents)
                    pairs, documents = ([], []), []
            yield from summed(pairs, documents)

    return texts.mapInArrow(count, _COUNTED).groupBy("kind", "key").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _with_words(counts: DataFrame, least: int) -> DataFrame:
    """_COUNTED: the counts, of pairs those seen ``least`` times, and what the pairs say of their words."""

    def derive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, key = batch.column("kind").to_numpy(), batch.column("key").to_numpy().view(np.uint64)
            n = np.stack([batch.column(c).to_numpy() for c in ("n0", "n1")], axis=1)
            pair = kind == _PAIR
            first, second = key[pair] >> np.uint64(32), key[pair] & np.uint64(0xFFFFFFFF)
            stay = ~pair | (n.sum(axis=1) >= least)
            out = [(kind[stay], key[stay], n[stay])]
            for of, words, values in ((_CONTEXT, first, n[pair]), (_KINDS, first, n[pair] > 0), (_CONTINUATION, second, n[pair] > 0)):
                distinct, at = np.unique(words, return_inverse=True)
                sums = [np.bincount(at, weights=values[:, c], minlength=len(distinct)) for c in (0, 1)]
                out.append((np.full(len(distinct), of), distinct, np.stack(sums, axis=1)))
            k, w, v = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k.astype(np.int32), w.view(np.int64), v[:, 0].astype(np.int64), v[:, 1].astype(np.int64))], ["kind", "key", "n0", "n1"])

    return counts.mapInArrow(derive, _COUNTED).groupBy("kind", "key").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def train(docs: DataFrame, labels: DataFrame, most_fit: int = MOST_FIT, least: int = LEAST_COUNT) -> Model:
    """Fit on the labelled rows; ids only join labels to texts."""
    marks = marked_labels(labels, most_fit)
    few = marks.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS
    marked = F.broadcast(marks) if few else marks
    counted = marks.where("role = 0").select("doc_id", "toxic")
    texts = docs.select("doc_id", "text").join(F.broadcast(counted) if few else counted, "doc_id", "left")
    held = durable(_with_words(_counts(texts.select("text", "toxic")), least))
    sums = {r["kind"]: r for r in held.groupBy("kind").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).collect()}
    model = Model()
    for kind in sorted(sums):
        # At most 1 / LEAST_SHARE rows for each class; of a context that stays, the number of its followers stays too.
        of = _CONTEXT if kind == _KINDS else kind
        enough = [(F.col(f"n{c}") > 0) & (F.col(f"n{c}") >= LEAST_SHARE * sums[of][f"n{c}"]) for c in (0, 1)]
        kept = held.where(F.col("kind") == of).where(F.col("n0") + F.col("n1") >= least).where(enough[0] | enough[1])
        if of != kind:
            kept = held.where(F.col("kind") == kind).join(F.broadcast(kept.select("key")), "key", "left_semi")
        kept = kept.select("key", "n0", "n1").toPandas()
        key = kept["key"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(key)
        model.keys[kind], model.counts[kind] = key[order], kept[["n0", "n1"]].to_numpy(np.float64)[order]
        model.totals[kind], model.distinct[kind] = model.counts[kind].sum(axis=0), (model.counts[kind] > 0).sum(axis=0)
    aside = docs.select("doc_id", "text").join(marked, "doc_id").where("role = 1").select("text", "toxic")
    fitted = _featured(aside, model).toPandas()
    x, y = np.array(fitted["features"].tolist()).reshape(-1, 5), fitted["toxic"].to_numpy(np.float64)
    if len(y) and 0 < y.sum() < len(y) and model.keys:
        model.curve = fit_curve(x, y)
    return model


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _featured(rows: DataFrame, model: Model) -> DataFrame:
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros((0, 5))]
            for _, _, data, bounds in text_slices(pa.Table.from_batches([batch])):
                found.append(model.features(*_words(data, bounds)))
            values = np.concatenate(found)
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(list(values), pa.list_(pa.float64()))], ["toxic", "features"])

    return rows.mapInArrow(measure, "toxic int, features array<double>")


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs with a score, 0 to 1, in the column ``name``; it replaces a column of that name, in any case."""
    rows = docs.drop(name)
    held = rows.sparkSession.sparkContext.broadcast(dict(vars(model)))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(**held.value)
        for batch in batches:
            found = [np.zeros(0)]
            for _, _, data, bounds in text_slices(pa.Table.from_batches([batch])):
                found.append(model.scores(*_words(data, bounds)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(found))], [*batch.schema.names, name])

    return rows.mapInArrow(rate, rows.withColumn(name, F.lit(0.0)).schema)


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0
