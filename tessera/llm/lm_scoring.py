"""Language-model scores from a log-frequency Bloom filter of word pairs.

A pair's count c has level 1 + floor(log_b c). The filter holds the pair once for each level up to its own, so membership probes
of level 1, 2, ... find the level again: never too low, seldom too high. Counts of words are exact. A word's probability mixes what follows
its context with the word's own share,

    p(w | h) = weight * least count of the level of (h, w) / c(h) + (1 - weight) * (c(w) + 1) / (N + V + 1),

where the weight depends on the level of c(h). Counts from the filter are rounded down, so the probabilities after
a context sum to no more than 1 but for false members. A pair is probed no further than its two words' counts allow.
The weights are fitted by deleted interpolation: every pair of the corpus votes, with one of its occurrences left out, in a table of
levels and ratios of the two estimates, whose size is fixed.

How it is distributed: texts are dealt into chunks by a hash of their row. A chunk sends each of its distinct words once to the word's bucket and
gets the exact counts back, in the same order; then it sends its distinct pairs, and each bucket makes its segment of the filter. The filter is broadcast if so many
tokens can't need more than MOST_BROADCAST bytes; a larger one stays where it is, and each segment is probed there for the pairs that chunks have sent it, and tells them the levels. Both
ways give the same scores. No task holds more than a chunk or a bucket, both of which follow the input in number.

Defined results: null text is the empty text, which has the end only; without rows to learn from every probability is 1. Repeated rows
repeat and count as often; an empty table gives none. Other columns pass through; added ones replace columns of their names in any case.
Words are known by 64 bits of their hash, pairs within a bucket by 40.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from tessera.llm._common import durable, partitions, release
from tessera.llm._shared import CHUNKS_A_PARTITION, PARTITION_BYTES
from tessera.llm._words import Words, as_binaries, dealt, joined, mixed, text_slices

#: The base of the levels; membership hashes of each level; the largest filter that is broadcast.
BASE, HASHES, MOST_BROADCAST = 1.5, 8, 64 << 20
#: The least count of each level.
LEAST = np.ceil(BASE ** np.arange(106)).astype(np.int64)
MOST_WEIGHT = 0.999
ADDED = ("n_tokens", "n_known", "base_score", "score")
_END, _START, _STEP = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F), np.uint64(0x9E3779B97F4A7C15)
_KEY = np.uint64((1 << 40) - 1)
_WORDS_SENT = "bucket int, chunk int, keys binary, counts binary"
_COUNTED = "chunk int, bucket int, kind int, held binary, n long, v long"
_PAIRS_SENT = "bucket int, chunk int, pairs binary"
_SEGMENT = "bucket int, chunk int, kind int, held binary, cells array<int>, votes array<long>"
#: Kinds of answers to a chunk.
_COUNTS, _LEVELS = range(2)
#: Of a cell: ratios are told apart by half powers of two, between 2^-20 and 2^20; cell 0 of a level is ratio 0.
_RATIOS = 82


def level_of(counts: np.ndarray) -> np.ndarray:
    """0 for 0, else 1 + floor(log_b count)."""
    return np.searchsorted(LEAST, counts, side="right")


def _places(keys: np.ndarray, level: int, sizes: np.ndarray) -> list[np.ndarray]:
    """The bits of each key at a level, in filters of these sizes."""
    first = mixed(keys + np.uint64(int(_STEP) * level & 0xFFFFFFFFFFFFFFFF))
    second = mixed(first) | np.uint64(1)
    return [(first + np.uint64(i) * second) % sizes for i in range(HASHES)]


def make_segment(keys: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The bytes of a filter that holds each key once for each level up to its own: half of the bits are set."""
    size = max(8, int(np.ceil(levels.sum() * HASHES / np.log(2) / 8)) * 8)
    bits = np.zeros(size, bool)
    for level in range(1, int(levels.max(initial=0)) + 1):
        held = keys[levels >= level]
        for place in _places(held, level, np.full(len(held), size, np.uint64)):
            bits[place.astype(np.int64)] = True
    return np.packbits(bits)


@dataclass
class Filter:
    """All segments one after the other; where each bucket's begins, and its bits (0: none)."""

    data: np.ndarray
    begins: np.ndarray
    sizes: np.ndarray

    @staticmethod
    def of(segments: list[tuple[int, bytes]], buckets: int) -> Filter:
        begins, sizes, at = np.zeros(buckets, np.int64), np.zeros(buckets, np.uint64), 0
        for bucket, bits in segments:
            begins[bucket], sizes[bucket] = at, 8 * len(bits)
            at += len(bits)
        return Filter(np.frombuffer(b"".join(b for _, b in segments), np.uint8), begins, sizes)

    def levels(self, buckets: np.ndarray, keys: np.ndarray, most: np.ndarray) -> np.ndarray:
        """The level of each key, by probes of one level after the other, up to ``most``."""
        out = np.zeros(len(keys), np.uint8)
        left = np.flatnonzero((most > 0) & (self.sizes[buckets] > 0))
        level = 1
        while len(left):
            begin = self.begins[buckets[left]]
            member = np.ones(len(left), bool)
            for place in _places(keys[left], level, self.sizes[buckets[left]]):
                at = place.astype(np.int64)
                member &= (self.data[begin + (at >> 3)] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
            left = left[member]
            out[left] = level
            level += 1
            left = left[most[left] >= level]
        return out


class _Chunk:
    """The tokens of a chunk's texts, and the chunk's distinct tokens in the order in which they are sent."""

    def __init__(self, table: pa.Table, buckets: int):
        self.n_texts = table.num_rows
        tokens, texts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for lo, hi, data, bounds in text_slices(table):
            words = Words(data, bounds, fold=True)
            n, each = hi - lo, np.bincount(words.text, minlength=hi - lo)
            token, text = np.full(len(words.hash) + n, _END), np.repeat(np.arange(n), each + 1)
            token[np.arange(len(words.hash)) + words.text] = words.hash
            tokens.append(token)
            texts.append(text + lo)
        self.tokens, self.texts, self.buckets = np.concatenate(tokens), np.concatenate(texts), buckets
        self.learns = table.column("learn").to_numpy(zero_copy_only=False).astype(bool)
        self.distinct, self.which = np.unique(self.tokens, return_inverse=True)

    def own_counts(self) -> np.ndarray:
        """Of each distinct token, in texts to learn from."""
        return np.bincount(self.which[self.learns[self.texts]], minlength=len(self.distinct))

    def take_counts(self, answers: pa.Table) -> None:
        """Sets the exact count of each token and of its context."""
        bucket = (self.distinct >> np.uint64(33)) % np.uint64(self.buckets)
        counts = np.zeros(len(self.distinct), np.int64)
        counts[np.argsort(bucket, kind="stable")] = joined(_in_order(answers, _COUNTS), np.int64)
        self.counts = counts[self.which]
        opens = np.ones(len(self.tokens), bool)
        opens[1:] = self.texts[1:] != self.texts[:-1]
        before = np.concatenate([self.tokens[:1], self.tokens[:-1]])
        self.context_counts = np.concatenate([self.counts[:1], self.counts[:-1]])
        # Every text has one start and one end.
        ends = counts[np.searchsorted(self.distinct, _END)] if len(self.distinct) else 0
        before[opens], self.context_counts[opens] = _START, ends
        self.pairs = mixed(before * _STEP + self.tokens)

    def distinct_pairs(self, every: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct pairs (every: of all texts, else of those to learn from), a place of each and how often it occurs in texts to learn from."""
        learns = self.learns[self.texts]
        among = np.arange(len(self.pairs)) if every else np.flatnonzero(learns)
        pairs, first, which = np.unique(self.pairs[among], return_index=True, return_inverse=True)
        return pairs, among[first], np.bincount(which[learns[among]], minlength=len(pairs))

    def most_levels(self, at: np.ndarray) -> np.ndarray:
        return level_of(np.minimum(self.counts[at], self.context_counts[at]))


def _in_order(answers: pa.Table, kind: int) -> pa.ChunkedArray:
    found = answers.filter(pc.equal(answers.column("kind"), kind)) if answers.num_rows else answers
    return found.sort_by("bucket").column("held")


def _bucket_of(pairs: np.ndarray, buckets: int) -> np.ndarray:
    return ((pairs >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


def _table(schema: str, *columns) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}
    fields = [f.split() for f in schema.split(", ")]
    return pa.table({name: pa.array(c, kinds[kind]) if not isinstance(c, pa.Array) else c for (name, kind), c in zip(fields, columns or [[]] * len(fields), strict=True)})


def _words_sent(buckets: int):
    def send(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        chunk = _Chunk(table, buckets)
        found, (keys, counts) = dealt(chunk.distinct, buckets, chunk.own_counts())
        return _table(_WORDS_SENT, found, np.full(len(found), key[0].as_py()), keys, counts)

    return send


def _words_counted(table: pa.Table) -> pa.Table:
    """Each chunk's words with their counts over all chunks, and a row (chunk -1) with the bucket's number of tokens and of different words."""
    keys, counts = joined(table.column("keys")), joined(table.column("counts"), np.int64)
    words, which = np.unique(keys, return_inverse=True)
    totals = np.zeros(len(words), np.int64)
    np.add.at(totals, which, counts)
    chunks, bucket = table.column("chunk").to_pylist(), table.column("bucket").to_pylist()
    each = np.array([len(b) // 8 for b in table.column("keys").to_pylist()], np.int64)
    held = pa.concat_arrays([as_binaries(totals[which], each), pa.array([b""], pa.binary())])
    nothing = [0] * len(chunks)
    return _table(_COUNTED, [*chunks, -1], [*bucket, bucket[0]], [_COUNTS] * (len(chunks) + 1), held, [*nothing, int(totals.sum())], [*nothing, int((totals > 0).sum())])


def _pairs_sent(buckets: int, every: bool):
    """A pair goes as one number: 40 bits of key, its count (in several parts if above 255) and the levels of its two words. every: also pairs that no text to learn from has."""

    def send(key: tuple[pa.Scalar, ...], table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _table(_PAIRS_SENT)
        chunk = _Chunk(table, buckets)
        chunk.take_counts(answers)
        pairs, at, n = chunk.distinct_pairs(every)
        packed = pairs & _KEY | level_of(chunk.context_counts[at]).astype(np.uint64) << np.uint64(48) | level_of(chunk.counts[at]).astype(np.uint64) << np.uint64(56)
        parts = _parts(n)
        share = np.full(int(parts.sum()), 255)
        share[np.cumsum(parts) - 1] = n - 255 * (parts - 1)
        found, (_, packed) = dealt(np.repeat(pairs, parts), buckets, np.repeat(packed, parts) | share.astype(np.uint64) << np.uint64(40))
        return _table(_PAIRS_SENT, found, np.full(len(found), key[0].as_py()), packed)

    return send


def _parts(counts: np.ndarray) -> np.ndarray:
    return np.maximum(1, -(-counts // 255))


def _segments(tokens: int, every: bool):
    """A bucket's part of the filter and its votes on the weights (chunk -1); with ``every``, also what its filter says of the pairs of each chunk, in the order sent."""

    def make(table: pa.Table) -> pa.Table:
        sent = joined(table.column("pairs"))
        order = np.argsort(sent & _KEY, kind="stable")
        packed = sent[order]
        key, parts = packed & _KEY, (packed >> np.uint64(40) & np.uint64(255)).astype(np.int64)
        new = np.concatenate([[True], key[1:] != key[:-1]])
        starts = np.flatnonzero(new)
        key, counts = key[starts], np.add.reduceat(parts, starts)
        context, word = ((packed[starts] >> np.uint64(s) & np.uint64(255)).astype(np.int64) for s in (48, 56))
        held = counts > 0
        bits = make_segment(key[held], level_of(counts[held])).tobytes()
        cells, votes = _votes(counts[held], context[held], word[held], tokens)
        bucket = table.column("bucket")[0].as_py()
        out = [_table(_SEGMENT, [bucket], [-1], [_LEVELS], [bits], [cells.tolist()], [votes.tolist()])]
        if every:
            found = Filter.of([(0, bits)], 1).levels(np.zeros(len(key), np.int64), key, np.minimum(context, word))
            levels = np.empty(len(sent), np.uint8)
            levels[order] = found[np.cumsum(new) - 1]
            n, each = table.num_rows, np.array([len(b) // 8 for b in table.column("pairs").to_pylist()], np.int64)
            out.append(_table(_SEGMENT, [bucket] * n, table.column("chunk").combine_chunks(), [_LEVELS] * n, as_binaries(levels, each), [None] * n, [None] * n))
        return pa.concat_tables(out)

    return make


def _votes(counts: np.ndarray, context: np.ndarray, word: np.ndarray, tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells and how many occurrences fall into each: by the context's level, and by the ratio of the two estimates with one occurrence left out of the pair, its context and its word."""
    middle = LEAST * BASE**0.5
    with np.errstate(divide="ignore"):
        left = np.where(counts > 1, LEAST[np.maximum(level_of(counts - 1), 1) - 1], 0)
        ratio = left / np.maximum(middle[context - 1] - 1, 1) / (np.maximum(middle[word - 1] - 1, 1) / tokens)
        step = np.where(ratio > 0, np.clip(np.round(2 * np.log2(ratio)), -40, 40) + 41, 0).astype(np.int64)
    cell, which = np.unique(context * _RATIOS + step, return_inverse=True)
    votes = np.zeros(len(cell), np.int64)
    np.add.at(votes, which, counts)
    return cell, votes


def fit_weights(votes: dict[int, int]) -> np.ndarray:
    """Of each level of a context the weight of its pairs, at which the votes (by cell) are likeliest."""
    weights = np.zeros(len(LEAST) + 1)
    cells = np.array(sorted(votes), np.int64)
    for level in np.unique(cells // _RATIOS).tolist():
        own = cells[cells // _RATIOS == level]
        step, n = own % _RATIOS, np.array([votes[c] for c in own.tolist()], np.float64)
        ratio = np.where(step > 0, 2.0 ** ((step - 41) / 2), 0.0)
        low, high = 0.0, MOST_WEIGHT
        for _ in range(60):
            middle = (low + high) / 2
            rising = (n * (ratio - 1) / (middle * (ratio - 1) + 1)).sum() > 0
            low, high = (middle, high) if rising else (low, middle)
        weights[level] = low
    return weights


@dataclass
class Model:
    """What chunks get back (counts, and levels if the filter isn't broadcast); the filter's segments; numbers of tokens and of different words; weights by level."""

    chunks: DataFrame
    buckets: int
    answers: DataFrame
    segments: DataFrame
    broadcast: bool
    tokens: int
    words: int
    weights: np.ndarray


# Each step is a function of its own, so that its shuffles can be released when it returns.
def _counted(chunks: DataFrame, buckets: int) -> DataFrame:
    sent = chunks.select("chunk", "text", "learn").groupBy("chunk").applyInArrow(_words_sent(buckets), _WORDS_SENT)
    return durable(sent.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_words_counted, _COUNTED))


def _filtered(chunks: DataFrame, counted: DataFrame, buckets: int, tokens: int, every: bool) -> DataFrame:
    sent = chunks.select("chunk", "text", "learn").groupBy("chunk").cogroup(counted.groupBy("chunk")).applyInArrow(_pairs_sent(buckets, every), _PAIRS_SENT)
    return durable(sent.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_segments(max(1, tokens), every), _SEGMENT))


def filter_bytes(tokens: int, buckets: int) -> int:
    """No filter of so many tokens is larger: a pair's level is at most its count."""
    return int(tokens * HASHES / np.log(2) / 8) + 16 * buckets


def learn(docs: DataFrame, learns: Column, most_broadcast: int = MOST_BROADCAST) -> Model:
    """Count the texts of the rows where ``learns`` is true, of docs with text; all rows are dealt into chunks, which score() needs."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(partitions(docs.sparkSession), -(-size // PARTITION_BYTES))
    others = [c for c in docs.columns if c != "text" and c.lower() not in ADDED]
    deal = F.pmod(F.xxhash64(*(F.col(c) for c, kind in docs.dtypes if kind in ("bigint", "int", "string"))), F.lit(buckets * CHUNKS_A_PARTITION)).cast("int")
    row = F.struct(*(F.col(c) for c in others)).alias("row") if others else F.lit(None).cast("struct<none:int>").alias("row")
    chunks = docs.select(deal.alias("chunk"), "text", F.coalesce(learns, F.lit(False)).alias("learn"), row).repartition(buckets, "chunk")
    counted = _counted(chunks, buckets)
    release(docs.sparkSession)
    totals = counted.where("chunk = -1").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    tokens, words = totals["n"] or 0, totals["v"] or 0
    fits = filter_bytes(tokens, buckets) <= most_broadcast
    answers = counted.where("chunk >= 0").select("chunk", "bucket", "kind", "held")
    made = _filtered(chunks, answers, buckets, tokens, not fits)
    release(docs.sparkSession)
    segments = made.where("chunk = -1")
    # At most as many rows as there are levels times ratios.
    cells = segments.select(F.explode(F.arrays_zip("cells", "votes")).alias("c")).groupBy("c.cells").agg(F.sum("c.votes").alias("n")).collect()
    if not fits:
        answers = answers.union(made.where("chunk >= 0").select("chunk", "bucket", "kind", "held"))
    return Model(chunks, buckets, answers, segments.select("bucket", F.col("held").alias("bits")), fits, tokens, words, fit_weights({r["cells"]: r["n"] for r in cells}))


def score(model: Model) -> DataFrame:
    """The rows that learn() was given with ADDED: tokens, known ones, and the log10 probability of the text by words alone and by the model."""
    spark, buckets, held = model.chunks.sparkSession, model.buckets, None
    if model.broadcast:
        # At most filter_bytes(), which learn() has compared with its bound.
        held = spark.sparkContext.broadcast(Filter.of([(r["bucket"], bytes(r["bits"])) for r in model.segments.collect()], buckets))
    tokens, words, weights = model.tokens, model.words, model.weights
    schema = StructType([f for f in model.chunks.schema if f.name in ("text", "row")] + [StructField(c, LongType() if c.startswith("n_") else DoubleType()) for c in ADDED])

    def rate(key: tuple[pa.Scalar, ...], table: pa.Table, answers: pa.Table) -> pa.Table:
        own = table.select(["text", "row"])
        if not table.num_rows:
            values = [np.zeros(0, np.int64)] * 2 + [np.zeros(0)] * 2
        else:
            chunk = _Chunk(table, buckets)
            chunk.take_counts(answers)
            pairs, at, n = chunk.distinct_pairs(True)
            bucket = _bucket_of(pairs, buckets)
            if held is not None:
                levels = held.value.levels(bucket, pairs & _KEY, chunk.most_levels(at))
            else:
                # A pair that was sent in parts was answered as often.
                parts = _parts(n)
                levels = np.zeros(int(parts.sum()), np.uint8)
                levels[np.argsort(np.repeat(bucket, parts), kind="stable")] = joined(_in_order(answers, _LEVELS), np.uint8)
                levels = levels[np.cumsum(parts) - parts]
            seen = np.where(levels > 0, LEAST[np.maximum(levels, 1).astype(np.int64) - 1], 0)[np.searchsorted(pairs, chunk.pairs)]
            alone = (chunk.counts + 1) / (tokens + words + 1)
            weight = weights[level_of(chunk.context_counts)]
            p = (1 - weight) * alone + weight * seen / np.maximum(chunk.context_counts, 1)
            sums = lambda x: np.bincount(chunk.texts, weights=x, minlength=chunk.n_texts)
            values = [np.bincount(chunk.texts, minlength=chunk.n_texts), np.bincount(chunk.texts[chunk.counts > 0], minlength=chunk.n_texts), sums(np.log10(alone)), sums(np.log10(p))]
        for name, value in zip(ADDED, values, strict=True):
            own = own.append_column(name, pa.array(value))
        return own

    scored = model.chunks.groupBy("chunk").cogroup(model.answers.groupBy("chunk")).applyInArrow(rate, schema)
    kept = [f.name for f in model.chunks.schema["row"].dataType if f.name != "none"]
    return scored.select("text", *(F.col("row")[c].alias(c) for c in kept), *ADDED)


def held_out(doc_id: Column) -> Column:
    """Rows that the registered query doesn't learn from: the checksum of the id is 2 modulo 7; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2
