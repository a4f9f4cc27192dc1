"""N-gram Jaccard join: all links between documents of 75% like 5-word shingle sets.

All sets are in one order: by hash, but shingles that very many documents have come after all others. Two sets
that link share one of their first shingles (a quarter of each set and one). Somewhat more of them are looked up
across the corpus: a set of which more occur nowhere else than any link allows can't link and is closed at once. The
open ones are compared, never as whole groups of pairs:

1. Equal sets are one class; one open document stands for it.
2. Classes with the same first shared shingle are compared exactly, in order of size, and only links
   that join two components are kept. This joins up most of each group of near copies.
3. Classes that share one of their other first shingles meet in tiles. A tile is in order of size: a set is compared with those in the
   band of sizes that can link with it. Hashed bitmap signatures bound the overlap from above: half of what two sizes add up to,
   less the bits in which two signatures differ. Pairs of one component are skipped, and of a large tile only the pairs outside its main component are
   tried, in blocks. What passes is held against whole signatures, then intersected exactly as sorted arrays. A pair is judged at its first shared shingle only,
   as far as that shows: each row of a tile has with it the BEFORE shared shingles before its own, and two rows that have one of these in common have met there.
4. Tiles are gone through twice. At first each row of a tile is tried with its nearest partner alone, which joins up nearly all that links, with no more pairs than rows.
   After that, all pairs of different components are tried: near copies are one component by then, so that their pairs, which grow with the square of their number, are not made.
5. Of two components the nearest pair is tried first, then all others if they are still apart. In one large tile a class meets
   at most NEAREST sets of another component; if there were more and the two are still apart, step 3 is repeated for these components with more, in the end with all.

Components then hold every link: a pair left out is either proven too unlike or
already joined. Links are exact up to collisions of 63-bit shingle hashes.

Defined results: null or wordless text has an empty set and links with nothing;
a text of one to four words has its whole sequence as one shingle; a null id
stands as itself for its document and never stands for others unless all ids of a class are null; rows with equal ids share a component when
their sets are equal; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import bounded_join, durable, release
from tessera.llm._shared import SENT, answered, answers_of, in_chunks, in_several, sent
from tessera.llm._words import Words, among, as_binaries, dealt, give_back, joined, keys_of, mixed, text_slices
from tessera.llm.components import components

WORDS, PERCENT = 5, 75
#: A shingle is common if a 256th of any texts of COUNTED_AT_ONCE shingles that are counted together, and 16 at least, have it. Which are called so changes the order of work only, so their number may be bounded.
COMMON_SHARE, COMMON_LEAST, MOST_COMMON, COUNTED_AT_ONCE = 256, 16, 1 << 16, 1 << 20
#: Rows compared at once in step 2; rows of a block of a large tile, and up to which a tile is small; how many sets of another component are tried first.
RUN, BLOCK, SMALL, NEAREST = 1024, 4096, 64, 16
#: 64-bit words of the signatures in tiles; how many of the shared shingles before its own a row of a tile has with it.
SIGNATURE, BEFORE = 8, 4

PROFILE = "node long, doc_id long, n_shingles long, key_a long, key_b long, bitmap binary, tokens binary, places binary, members binary"
POSTED = "token long, node long, component long, n_shingles int, place int, signature binary, before binary"
FOUND = "a long, b long, of_a long, of_b long, differ int, more boolean"


def prefix_length(n: np.ndarray) -> np.ndarray:
    """How many least shingles of a set of n must hold a shared one if it links with any other."""
    return n - (PERCENT * n + 99) // 100 + 1


def lookup_length(n: np.ndarray) -> np.ndarray:
    """How many are looked up: half as many again."""
    least = prefix_length(n)
    return np.minimum(n, least + least // 2)


def least_shared(n: np.ndarray) -> np.ndarray:
    """How many looked-up shingles a set of n has in common with any that it links with: those that both lookups must hold."""
    sizes, at = np.unique(n, return_inverse=True)
    least = np.zeros(len(sizes), np.int64)
    for i, a in enumerate(sizes):
        b = np.arange((PERCENT * a + 99) // 100, 100 * a // PERCENT + 1)
        both = least_overlap(a, b)
        held = np.minimum(lookup_length(a) - (a - both), lookup_length(b) - (b - both))
        least[i] = held[both <= np.minimum(a, b)].min()
    return least[at]


def least_overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least overlap with which sets of these sizes link: 100 o >= 75 (a + b - o)."""
    return (PERCENT * (a + b) + PERCENT + 99) // (100 + PERCENT)


def bitmap_words(n: int) -> int:
    """64-bit words of the signature of n shingles: four to eight bits for each, so that few differences coincide."""
    return max(SIGNATURE, 1 << (int(n) * 4 // 64).bit_length())


def common_shingles(docs: DataFrame, words: int = WORDS) -> np.ndarray:
    """The hashes (see _Sets) of shingles that very many documents have, in order; at most MOST_COMMON of them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def frequent(held: list[np.ndarray], n_texts: int) -> pa.RecordBatch:
            values, least = np.concatenate(held or [np.zeros(0, np.uint64)]), max(COMMON_LEAST, n_texts // COMMON_SHARE)
            # Only hashes in parts with enough of them are told apart.
            part = (values >> np.uint64(43)).astype(np.int32)
            found, n = np.unique(values[np.bincount(part, minlength=1 << 20)[part] >= least], return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(found[n >= least].astype(np.int64)), pa.array(n[n >= least])], ["token", "n"])

        for batch in batches:
            held, n_texts = [], 0
            for lo, hi, data, bounds in text_slices(pa.Table.from_batches([batch])):
                value, inside = Words(data, bounds, fold=True).windows(words)
                held.append(value[inside] >> np.uint64(1))
                n_texts += hi - lo
                if sum(map(len, held)) >= COUNTED_AT_ONCE:
                    yield frequent(held, n_texts)
                    held, n_texts = [], 0
            yield frequent(held, n_texts)

    counts = docs.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return np.sort(np.array([r["token"] for r in counts.orderBy(F.desc("n"), "token").limit(MOST_COMMON).collect()], np.uint64))


class _Sets:
    """The shingle sets of a chunk, text by text: sorted distinct hashes of 63 bits, one after the other. Those of common shingles have the highest bit set, so they come last."""

    def __init__(self, table: pa.Table, words: int, common: np.ndarray):
        self.keys = keys_of(table)
        hashes, texts = [], []
        for lo, _, data, bounds in text_slices(table):
            found = Words(data, bounds, fold=True)
            value, inside = found.windows(words)
            owner = found.text[: len(value)][inside]
            value = value[inside]
            # Texts with fewer words: the whole sequence is one shingle.
            n_words = np.bincount(found.text, minlength=found.n_texts)
            for k in range(1, words):
                short = np.flatnonzero(n_words == k)
                if len(short):
                    at = np.searchsorted(found.text, short)
                    whole = found.windows(k)[0][at]
                    value, owner = np.concatenate([value, mixed(whole + np.uint64(k))]), np.concatenate([owner, short])
            if (n_words < words).any():
                order = np.argsort(owner, kind="stable")
                value, owner = value[order], owner[order]
            value = value >> np.uint64(1)
            value |= among(value, common).astype(np.uint64) << np.uint64(63)
            edges = np.searchsorted(owner, np.arange(found.n_texts + 1)).tolist()
            for a, b in zip(edges, edges[1:], strict=False):
                value[a:b].sort()
            new = np.ones(len(value), bool)
            new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
            hashes.append(value[new])
            texts.append((lo + owner[new]).astype(np.int32))
        self.hash = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.text = np.concatenate(texts) if texts else np.zeros(0, np.int32)
        del hashes, texts
        self.edges = np.searchsorted(self.text, np.arange(len(self.keys) + 1))
        self.sizes = np.diff(self.edges)
        self.place = (np.arange(len(self.hash), dtype=np.int64) - self.edges[self.text]).astype(np.int32)
        sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(self.hash ^ np.uint64(seed)))]) for seed in (0x51ED27, 0xC0FFEE11)]
        self.names = [(s[self.edges[1:]] - s[self.edges[:-1]]).view(np.int64) for s in sums]
        # Of texts with equal sets in this chunk, only the first speaks for them.
        order = np.lexsort((self.keys, self.names[1], self.names[0], self.sizes))
        first = np.ones(len(order), bool)
        same = [x[order][1:] == x[order][:-1] for x in (self.names[0], self.names[1], self.sizes)]
        first[1:] = ~(same[0] & same[1] & same[2])
        self.speaks = np.zeros(len(order), bool)
        self.speaks[order[first]] = True
        self.leading = self.speaks[self.text] & (self.place < lookup_length(self.sizes)[self.text])

    def bitmap(self, i: int) -> bytes:
        """Each bit is the parity of the shingles that hash to it, so a narrower bitmap is the fold of a wider one."""
        bits = 64 * bitmap_words(self.sizes[i])
        at = (self.hash[self.edges[i] : self.edges[i + 1]] % np.uint64(bits)).astype(np.int64)
        return np.packbits(np.bincount(at, minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()

    def members(self, i: int) -> bytes:
        return self.hash[self.edges[i] : self.edges[i + 1]].tobytes()


def profiles(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Each document's set size and name; if it is open, and the first in its chunk with this set, also its signature, its shared least shingles and the set."""
    common = common_shingles(docs, words)
    chunks, buckets = in_chunks(docs.select("doc_id", "text"))

    def ask(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        sets = _Sets(table, words, common)
        found, cut = dealt(np.unique(sets.hash[sets.leading]), buckets)
        return sent(key[0].as_py(), found, cut[0], pa.array([b""] * len(found), pa.binary()))

    def profile(key: tuple[pa.Scalar, ...], table: pa.Table, answers: pa.Table) -> pa.Table:
        sets = _Sets(table, words, common)
        tokens = sets.hash[sets.leading]
        distinct, counts = np.unique(tokens, return_counts=True)
        shared = np.zeros(len(sets.hash), bool)
        shared[np.flatnonzero(sets.leading)] = among(tokens, np.union1d(answers_of(answers, 0), distinct[counts > 1]))
        n_shared = np.bincount(sets.text[shared], minlength=len(sets.keys))
        least = prefix_length(sets.sizes)
        is_open = sets.speaks & (sets.sizes > 0) & (n_shared >= least_shared(sets.sizes))
        shared &= is_open[sets.text] & (sets.place < least[sets.text])
        n_shared = np.bincount(sets.text[shared], minlength=len(sets.keys))
        open_ = np.flatnonzero(is_open)
        empty = [b""] * len(sets.keys)
        bitmaps, members = list(empty), list(empty)
        for i in open_.tolist():
            bitmaps[i], members[i] = sets.bitmap(i), sets.members(i)
        return pa.table({
            "node": pa.array(key[0].as_py() << 32 | np.arange(len(sets.keys), dtype=np.int64)),
            "doc_id": table.column("doc_id").cast(pa.int64()), "n_shingles": pa.array(sets.sizes, pa.int64()), "key_a": pa.array(sets.names[0]), "key_b": pa.array(sets.names[1]),
            "bitmap": pa.array(bitmaps, pa.binary()), "tokens": as_binaries(sets.hash[shared], n_shared), "places": as_binaries(sets.place[shared].astype(np.int32), n_shared), "members": pa.array(members, pa.binary()),
        })

    asked = chunks.groupBy("chunk").applyInArrow(ask, SENT)
    answers = answered(asked, buckets, 0, in_several)
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(profile, PROFILE)


def _may_link(a: int, b: int, bits_a: bytes, bits_b: bytes) -> bool:
    """Whether sets of these sizes and signatures can have the overlap that links them."""
    need = int(least_overlap(np.int64(a), np.int64(b)))
    if need > min(a, b):
        return False
    x, y = folded(np.frombuffer(bits_a, np.uint64)[None], len(bits_b) // 8), folded(np.frombuffer(bits_b, np.uint64)[None], len(bits_a) // 8)
    return a + b - int(np.bitwise_count(x ^ y).sum()) >= 2 * need


def _links(held_a: bytes, held_b: bytes) -> bool:
    """Whether two sets, as sorted arrays, link."""
    a, b = np.frombuffer(held_a, np.uint64), np.frombuffer(held_b, np.uint64)
    return int(among(a, b).sum()) >= int(least_overlap(np.int64(len(a)), np.int64(len(b))))


def folded(bitmaps: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (a row each) folded down to so many words, if they have more."""
    while bitmaps.shape[1] > words:
        half = bitmaps.shape[1] // 2
        bitmaps = bitmaps[:, :half] ^ bitmaps[:, half:]
    return bitmaps


def _signatures(bitmaps: list[bytes]) -> np.ndarray:
    """Each bitmap folded to SIGNATURE words, a row each."""
    rows = [folded(np.frombuffer(b, np.uint64)[None], SIGNATURE) for b in bitmaps]
    return np.concatenate(rows) if rows else np.zeros((0, SIGNATURE), np.uint64)


def _can_link(n_a: np.ndarray, n_b: np.ndarray, differ: np.ndarray) -> np.ndarray:
    need = least_overlap(n_a, n_b)
    return (need <= np.minimum(n_a, n_b)) & (n_a + n_b - differ >= 2 * need)


def _first_links(rows: DataFrame) -> DataFrame:
    """(a, b): links between classes with the same first shared shingle, only those that join components."""
    first = rows.select(F.substring("tokens", 1, 8).alias("token"), "node", "n_shingles", "bitmap", "members")
    first = first.repartition("token").sortWithinPartitions("token", "n_shingles")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _forest(*(batch.column(c).to_pylist() for c in ("token", "n_shingles", "bitmap", "members")))
            node = batch.column("node").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(node[found[:, 0]]), pa.array(node[found[:, 1]])], ["a", "b"])
        give_back()

    return first.mapInArrow(link, "a long, b long")


def _forest(tokens: list[bytes], sizes: list[int], bitmaps: list[bytes], members: list[bytes]) -> np.ndarray:
    """Links (pairs of rows) that join the rows of each run of equal tokens, in order of size, into components; long runs are cut."""
    n, count = np.array(sizes, np.int64), len(tokens)
    starts, held = [], -1
    for i, token in enumerate(tokens):
        if i == 0 or token != tokens[i - 1] or i - held >= RUN:
            starts.append(i)
            held = i
    ends = np.repeat(np.append(starts[1:], count), np.diff(np.append(starts, count))).astype(np.int64) if starts else np.zeros(0, np.int64)
    signs, label, out = _signatures(bitmaps), np.arange(count), []
    x, d = np.arange(count), 1
    while True:
        x = x[x + d < ends[x]]
        x = x[PERCENT * n[x + d] <= 100 * n[x]]
        if not len(x):
            return np.array(out, np.int64).reshape(-1, 2)
        i = x[label[x] != label[x + d]]
        i = i[_can_link(n[i], n[i + d], np.bitwise_count(signs[i] ^ signs[i + d]).sum(axis=1, dtype=np.int64))]
        for a, b in zip(i.tolist(), (i + d).tolist(), strict=True):
            if label[a] != label[b] and _may_link(sizes[a], sizes[b], bitmaps[a], bitmaps[b]) and _links(members[a], members[b]):
                out.append((a, b))
                lo = int(starts[int(np.searchsorted(starts, a, side="right")) - 1])
                run = label[lo : ends[a]]
                run[run == label[b]] = label[a]
        d += 1


def _postings(rows: DataFrame, signed: bool) -> DataFrame:
    """POSTED: the shared first shingles of each row (node, component, ...); the signatures and the shingles before are left out unless signed."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.array([len(t) // 8 for t in batch.column("tokens").to_pylist()], np.int64)
            tokens, places = joined(batch.column("tokens"), np.int64), joined(batch.column("places"), np.int32)
            node, component, size = (np.repeat(batch.column(c).to_numpy(zero_copy_only=False), counts) for c in ("node", "component", "n_shingles"))
            signs = np.repeat(_signatures(batch.column("bitmap").to_pylist()), counts, axis=0) if signed else np.zeros((len(tokens), 0), np.uint64)
            columns = [pa.array(x) for x in (tokens, node, component, size.astype(np.int32), places)]
            before = _those_before(tokens, counts) if signed else np.zeros((len(tokens), 0), np.int64)
            columns += [as_binaries(x.ravel(), np.full(len(tokens), x.shape[1])) for x in (signs, before)]
            yield pa.RecordBatch.from_arrays(columns, ["token", "node", "component", "n_shingles", "place", "signature", "before"])
        give_back()

    return rows.select("node", "component", "n_shingles", "bitmap", "tokens", "places").mapInArrow(unpack, POSTED)


def _those_before(tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The BEFORE tokens before each in its own set (a row each; 0: none), of sets of these lengths, one after the other."""
    at = np.arange(len(tokens))
    place = at - np.repeat(np.cumsum(counts) - counts, counts)
    return np.stack([np.where(place >= k, tokens[np.maximum(at - k, 0)], 0) for k in range(1, BEFORE + 1)], axis=1)


def size_band(n: Column) -> Column:
    """Bands of sizes whose ends differ by a third: sets that link lie in one band or in neighbours."""
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(100.0 / PERCENT)) + 1e-9).cast("int")


def _tiles(rows: DataFrame) -> DataFrame:
    """Postings dealt into tiles, with ``home``. The rows of a shingle are a tile.

    Where they are more than BLOCK, each is at home in one block of its size band. Of these only rows outside the shingle's main
    component also visit the blocks of their band and of its neighbours, so that a large group of near copies is not multiplied.
    """
    posted, columns = _postings(rows, True), ["home", "node", "component", "n_shingles", "place", "signature", "before"]
    counts = _postings(rows, False)
    large = durable(counts.groupBy("token").agg(F.count("*").alias("_n")).where(F.col("_n") > BLOCK).select("token"))
    if not large.limit(1).count():
        return posted.select(F.col("token").alias("tile"), F.lit(True).alias("home"), *columns[1:])
    tokens = large.select(F.col("token").alias("_token"))
    by = bounded_join(counts, tokens, F.col("token") == F.col("_token")).groupBy("token", "component").agg(F.count("*").alias("_n"))
    main = durable(by.groupBy(F.col("token").alias("_token")).agg(F.max_by("component", F.struct("_n", "component")).alias("_main"), F.count("*").alias("_kinds")))
    small = bounded_join(posted, tokens, F.col("token") == F.col("_token"), "left_anti")
    at = bounded_join(posted, main.where("_kinds > 1").select("_token", "_main"), F.col("token") == F.col("_token")).withColumn("band", size_band(F.col("n_shingles"))).drop("_token")
    blocks = at.groupBy(F.col("token").alias("_token"), F.col("band").alias("_band")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    blocks = durable(blocks)
    own = lambda c: F.pmod(F.xxhash64("node"), F.col(c)).cast("int")
    here = (F.col("token") == F.col("_token")) & (F.col("band") == F.col("_band"))
    home = bounded_join(at, blocks, here).withColumn("home", F.lit(True)).withColumn("block", own("blocks"))
    guests = at.where("component <> _main").withColumn("_own", F.col("band")).withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    guests = bounded_join(guests, blocks, here).withColumn("home", F.lit(False)).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    guests = guests.where((F.col("band") != F.col("_own")) | (F.col("block") != own("blocks")))
    dealt_ = home.select(*guests.drop("_own").columns).unionByName(guests.drop("_own")).select(F.xxhash64("token", "band", "block").alias("tile"), *columns)
    return small.select(F.xxhash64("token").alias("tile"), F.lit(True).alias("home"), *columns[1:]).unionByName(dealt_)


def _tile_candidates(rows: DataFrame, nearest: int) -> DataFrame:
    """FOUND: pairs of classes of different components that meet in a tile and that no bound rules out; if nearest is 0, each row's nearest in a tile alone."""
    tiles = _tiles(rows).repartition("tile").sortWithinPartitions("tile", "n_shingles")

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            # The last tile may go on in the next batch.
            rest = pa.concat_tables([*([] if rest is None else [rest]), pa.Table.from_batches([batch])])
            tile = rest.column("tile").to_numpy()
            cut = int(np.searchsorted(tile, tile[-1])) if len(tile) else 0
            if cut:
                yield _compared(rest.slice(0, cut), nearest)
                rest = rest.slice(cut)
        if rest is not None and rest.num_rows:
            yield _compared(rest, nearest)
        rest = None
        give_back()

    return tiles.mapInArrow(candidates, FOUND).groupBy("a", "b", "of_a", "of_b", "more").agg(F.min("differ").alias("differ"))


def _compared(table: pa.Table, nearest: int) -> pa.RecordBatch:
    """Candidates in whole tiles, which stand one after the other, each in order of size."""
    col = {c: table.column(c).to_numpy() for c in ("tile", "home", "node", "component", "place")}
    n = table.column("n_shingles").to_numpy().astype(np.int64)
    signs = joined(table.column("signature")).reshape(-1, SIGNATURE)
    col["before"] = joined(table.column("before"), np.int64).reshape(-1, BEFORE)
    first = np.flatnonzero(np.concatenate([[True], col["tile"][1:] != col["tile"][:-1]]))
    lengths = np.diff(np.append(first, len(n)))
    pairs = [_pairs_of_small(first[lengths <= SMALL], lengths[lengths <= SMALL], col, n, signs)]
    more = [np.zeros(len(pairs[0]), bool)]
    for lo, length in zip(first[lengths > SMALL].tolist(), lengths[lengths > SMALL].tolist(), strict=True):
        found, left = _pairs_of_large(lo, lo + length, col, n, signs, nearest)
        pairs.append(found)
        more.append(left)
    i, j = np.concatenate(pairs).T
    more = np.concatenate(more)
    if not nearest:
        kept = _nearest_of_each(i, j, n, signs)
        i, j, more = i[kept], j[kept], more[kept]
    swap = col["node"][i] > col["node"][j]
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    differ = np.bitwise_count(signs[i] ^ signs[j]).sum(axis=1, dtype=np.int32)
    columns = [col["node"][i], col["node"][j], col["component"][i], col["component"][j], differ, more]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "b", "of_a", "of_b", "differ", "more"])


def _nearest_of_each(i: np.ndarray, j: np.ndarray, n: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Which of these pairs of rows are some row's nearest, by the share of bits that differ."""
    share = np.bitwise_count(signs[i] ^ signs[j]).sum(axis=1, dtype=np.int64) / (n[i] + n[j])
    sides, pair = np.concatenate([i, j]), np.tile(np.arange(len(i)), 2)
    order = np.lexsort((pair, share[pair], sides))
    new = np.ones(len(order), bool)
    new[1:] = sides[order][1:] != sides[order][:-1]
    return np.unique(pair[order[new]])


def _like(i: np.ndarray, j: np.ndarray, col: dict, n: np.ndarray, signs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the pairs of rows may link and have not met at a shingle before, and in how many bits their signatures differ."""
    need = least_overlap(n[i], n[j])
    # Nothing before this shingle is shared, or the pair meets there too.
    fits = need <= np.minimum(n[i] - col["place"][i], n[j] - col["place"][j])
    fits &= (col["component"][i] != col["component"][j]) & (col["home"][i] | col["home"][j])
    differ = np.zeros(len(i), np.int64)
    differ[fits] = np.bitwise_count(signs[i[fits]] ^ signs[j[fits]]).sum(axis=1, dtype=np.int64)
    fits &= n[i] + n[j] - differ >= 2 * need
    at = np.flatnonzero(fits)
    x, y = col["before"][i[at]], col["before"][j[at]]
    for k in range(BEFORE):
        fits[at] &= ~((x == y[:, k : k + 1]) & (x != 0)).any(axis=1)
    return fits, differ


def _pairs_of_small(first: np.ndarray, lengths: np.ndarray, col: dict, n: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """All candidates in these tiles: rows are compared with those d places on, for each d, as long as sizes can link."""
    ends = np.zeros(len(n), np.int64)
    for k in range(int(lengths.max()) if len(lengths) else 0):
        at = first[lengths > k]
        ends[at + k] = (first + lengths)[lengths > k]
    x, d, out = np.flatnonzero(ends), 1, [np.zeros((0, 2), np.int64)]
    while True:
        x = x[x + d < ends[x]]
        x = x[PERCENT * n[x + d] <= 100 * n[x]]
        if not len(x):
            return np.concatenate(out)
        i = x[_like(x, x + d, col, n, signs)[0]]
        out.append(np.stack([i, i + d], axis=1))
        d += 1


def _pairs_of_large(lo: int, hi: int, col: dict, n: np.ndarray, signs: np.ndarray, nearest: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidates in one tile, and which of them stand for more: each row outside the tile's main component against all in its band of sizes."""
    names, counts = np.unique(col["component"][lo:hi], return_counts=True)
    minor = col["component"][lo:hi] != names[np.argmax(counts)]
    out, more = [np.zeros((0, 2), np.int64)], [np.zeros(0, bool)]
    for i in (lo + np.flatnonzero(minor)).tolist():
        low, high = np.searchsorted(n[lo:hi], [-(-PERCENT * n[i] // 100), 100 * n[i] // PERCENT + 1])
        j = np.arange(lo + low, lo + high)
        j = j[(col["component"][j] != col["component"][i]) & ~(minor[j - lo] & (j < i))]
        ok, differ = _like(np.full(len(j), i), j, col, n, signs)
        j, differ = j[ok], differ[ok]
        if not nearest:
            j = j[np.lexsort((j, differ / (n[i] + n[j])))[:1]]
            more.append(np.zeros(len(j), bool))
        elif len(j) > nearest:
            order = np.lexsort((j, differ, col["component"][j]))
            j = j[order]
            new = np.concatenate([[True], col["component"][j][1:] != col["component"][j][:-1]])
            nth = np.arange(len(j)) - np.maximum.accumulate(np.where(new, np.arange(len(j)), 0))
            more.append(nth[nth <= nearest] == nearest)
            j = j[nth <= nearest]
        else:
            more.append(np.zeros(len(j), bool))
        out.append(np.stack([np.full(len(j), i), j], axis=1))
    return np.concatenate(out), np.concatenate(more)


def _checked(pairs: DataFrame, rows: DataFrame, held: str, check) -> DataFrame:
    """Those of the pairs (a, b, of_a, of_b) that check(n_a, n_b, held_a, held_b) lets pass; only rows of some pair are shuffled."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("_node")).distinct()
    sides = bounded_join(rows.select("node", "n_shingles", held), nodes, F.col("node") == F.col("_node"), "left_semi")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = zip(*(batch.column(c).to_pylist() for c in ("n_a", "n_b", "held_a", "held_b")), strict=True)
            yield batch.select(["a", "b", "of_a", "of_b"]).filter(pa.array([check(*x) for x in each], pa.bool_()))
        give_back()

    found = pairs.join(sides.toDF("a", "n_a", "held_a"), "a").join(sides.toDF("b", "n_b", "held_b"), "b")
    return found.select("a", "b", "of_a", "of_b", "n_a", "n_b", "held_a", "held_b").mapInArrow(kept, "a long, b long, of_a long, of_b long")


def _linking(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """(a, b): the components that the pairs link: by whole signatures, then by exact intersection."""
    near = durable(_checked(pairs, rows, "bitmap", _may_link))
    found = _checked(near, rows, "members", lambda n_a, n_b, a, b: _links(a, b))
    return durable(found.select(F.col("of_a").alias("a"), F.col("of_b").alias("b")).distinct())


def _joined_up(named: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) after links (a, b) between components."""
    merged = durable(components(links)).select(F.col("node").alias("_was"), F.col("component").alias("_least"))
    return durable(bounded_join(named, merged, F.col("component") == F.col("_was"), "left").select("node", F.coalesce("_least", "component").alias("component")))


def _apart(pairs: DataFrame, named: DataFrame) -> DataFrame:
    """Those of the pairs whose components are still two, by their present names."""
    side = lambda c: named.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
    return pairs.select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b").where("of_a <> of_b")


def jaccard_components(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id): of each document the least id it reaches by links, and the least id with an equal set."""
    held = durable(profiles(docs, words))
    release(docs.sparkSession)
    key, open_ = ["n_shingles", "key_a", "key_b"], held.where(F.length("tokens") > 0)
    # One row for each different set; a node of its own stands for it, so null and repeated ids don't matter.
    node = F.min(F.when(F.length("tokens") > 0, F.col("node")))
    classes = durable(held.where("n_shingles > 0").groupBy(*key).agg(F.min("doc_id").alias("class_id"), node.alias("node")))
    stands = classes.where("node is not null").select(F.col("node").alias("_stands"))
    open_ = bounded_join(open_, stands, F.col("node") == F.col("_stands"), "left_semi")

    alone = stands.select(F.col("_stands").alias("node"), F.col("_stands").alias("component"))
    named = _joined_up(alone, durable(_first_links(open_)))
    rows = bounded_join(open_, named.select(F.col("node").alias("_node"), "component"), F.col("node") == F.col("_node"))
    named = _joined_up(named, _linking(durable(_tile_candidates(rows, 0)), open_))
    release(docs.sparkSession)
    nearest, within = NEAREST, None
    while nearest:
        part = named if within is None else named.join(within, "component", "left_semi")
        rows = bounded_join(open_, part.select(F.col("node").alias("_node"), "component"), F.col("node") == F.col("_node"))
        found = durable(_tile_candidates(rows, nearest))
        pairs = found.where("not more")
        first = pairs.groupBy("of_a", "of_b").agg(F.min_by(F.struct("a", "b"), F.struct("differ", "a", "b")).alias("_")).select("_.a", "_.b", "of_a", "of_b")
        first = durable(first)
        named = _joined_up(named, _linking(first, open_))
        others = durable(_apart(pairs.join(first, ["a", "b"], "left_anti"), named))
        if others.limit(1).count():
            named = _joined_up(named, _linking(others, open_))
        release(docs.sparkSession)
        # Components of rows that had more partners in another one than were tried, if that is still another.
        within, nearest = durable(_apart(found.where("more"), named).select(F.explode(F.array("of_a", "of_b")).alias("component")).distinct()), nearest << 6
        nearest = nearest if within.limit(1).count() else 0

    named = classes.join(named, "node", "left").withColumn("component", F.coalesce("component", "node", F.xxhash64(*key)))
    least = named.groupBy("component", F.col("node").isNull().alias("alone")).agg(F.min("class_id").alias("component_id"))
    named = named.join(least, (named["component"] == least["component"]) & (named["node"].isNull() == least["alone"])).select(*key, "class_id", "component_id")
    out = held.select("doc_id", *key).join(named, key, "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("class_id", "doc_id").alias("class_id"))
