"""Search: BM25, exact cosine neighbours, rank fusion, gates, collapse and rejection.

Ranked tables have (query_id, chunk_id, rank, score); ``ord`` is a chunk's place in
the corpus and breaks ties as a stable sort would.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from tessera.functions.text import lexical_coverage, tokens

K1, B, RRF_K = 1.5, 0.75, 60
RECALL_FACTOR, RECALL_MOST = 3, 15
#: Queries, and chunks of the corpus, that meet in a tile.
QUERY_BLOCK = 2048
#: More query terms than these are joined by a shuffle; fewer go to the tasks, which score about so many chunks for queries at once.
BROADCAST_TERMS, SCORES = 100_000, 1 << 22
#: About how many vectors each side of a tile of cosine_pairs has at least and, in corpora of more than PAIR_BLOCKS such blocks, at most; and rows that are multiplied at once.
PAIR_BLOCK, LARGE_PAIR_BLOCK, PAIR_BLOCKS, PAIR_ROWS = 2048, 8192, 16, 1024


def top_k(ranked: DataFrame, k: int, order: list[Column], by: str = "query_id") -> DataFrame:
    """The first k rows of each query with their rank from 1."""
    return ranked.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)


def token_counts(corpus: DataFrame) -> DataFrame:
    """(token, n, docs): how often each token stands in the chunks, and in how many different ones by their ids.

    A chunk's distinct tokens are told apart where it is read, so that tasks send one row for each token, not for each token of each
    chunk; only those of ids that stand in several rows are brought together.
    """

    def marked(chunks: DataFrame) -> DataFrame:
        words = chunks.select("chunk_id", F.sort_array(tokens(F.col("text"))).alias("words"))
        first = lambda w, i: (i == 0) | (w != F.get("words", i - 1))
        return words.select("chunk_id", F.inline(F.transform("words", lambda w, i: F.struct(w.alias("token"), first(w, i).alias("first")))))

    def counted(chunks: DataFrame) -> DataFrame:
        return marked(chunks).groupBy("token").agg(F.count("*").alias("n"), F.count_if(F.col("first") & F.col("chunk_id").isNotNull()).alias("docs"))

    repeated = corpus.where("chunk_id is not null").groupBy("chunk_id").agg(F.count("*").alias("_n")).where("_n > 1").select("chunk_id")
    if not repeated.limit(1).count():
        return counted(corpus)
    several = marked(corpus.join(repeated, "chunk_id", "left_semi"))
    exact = several.groupBy("token").agg(F.count("*").alias("n"), F.countDistinct("chunk_id").alias("docs"))
    return counted(corpus.join(repeated, "chunk_id", "left_anti")).unionByName(exact).groupBy("token").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def bm25_postings(corpus: DataFrame) -> DataFrame:
    """(term, chunk_id, ord, tf, dl) of a corpus (chunk_id, ord, text)."""
    terms = corpus.select("chunk_id", "ord", F.explode(tokens(F.col("text"))).alias("term"))
    counts = terms.groupBy("chunk_id", "ord", "term").agg(F.count("*").alias("tf"))
    # Lengths are sums of the counts: both aggregates follow from one shuffle by chunk.
    return counts.withColumn("dl", F.sum("tf").over(Window.partitionBy("chunk_id")))


def bm25_search(corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Top k chunks of each query (query_id, text) by BM25; distinct query terms, positive scores only.

    Two passes over the corpus, whose chunk_id is unique: one counts chunks, lengths and the document frequencies of terms that some query has, the other scores chunks where they are
    read. A task returns its own best k of each query, so neither postings nor scores are shuffled. Very many query terms are joined instead (_bm25_joined).
    """
    wanted = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).limit(BROADCAST_TERMS + 1).collect()
    if len(wanted) > BROADCAST_TERMS:
        return _bm25_joined(corpus, queries, k)
    asking, terms = ({v: i for i, v in enumerate(dict.fromkeys(r[c] for r in wanted))} for c in ("query_id", "term"))
    # Which queries have a term: queries[start[term] : start[term + 1]].
    term_of, query_of = (np.array([known[r[c]] for r in wanted], np.int64) for known, c in ((terms, "term"), (asking, "query_id")))
    queries_of, start = query_of[np.argsort(term_of, kind="stable")], np.concatenate([[0], np.bincount(term_of, minlength=len(terms)).cumsum()])
    vocabulary, n_terms, n_asking = pa.array(list(terms), pa.string()), len(terms), len(asking)
    split = corpus.select("chunk_id", "ord", tokens(F.col("text")).alias("tokens"))

    def postings(tokens: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Lengths, and row, term and count of each of the rows' terms that are asked for."""
        lengths = pc.list_value_length(tokens).to_numpy(zero_copy_only=False).astype(np.int64)
        code = pc.index_in(tokens.flatten(), value_set=vocabulary).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        key, tf = np.unique((np.repeat(np.arange(len(lengths)), lengths) * n_terms + code)[code >= 0], return_counts=True)
        return lengths, key // max(n_terms, 1), key % max(n_terms, 1), tf

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last two places are the chunks and their lengths.
        held = np.zeros(n_terms + 2, np.int64)
        for batch in batches:
            lengths, _, term, _ = postings(batch.column("tokens"))
            held[:n_terms] += np.bincount(term, minlength=n_terms)
            held[n_terms:] += [len(lengths), lengths.sum()]
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(held)), pa.array(held[held > 0])], ["term", "n"])

    totals = np.zeros(n_terms + 2)
    for r in split.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect() if wanted else []:
        totals[r["term"]] = r["n"]
    df, n, length = totals[:n_terms], totals[n_terms], totals[n_terms + 1]
    idf = np.log((n - df + 0.5) / (df + 0.5) + 1)
    mean = length / n if length else 1.0

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        step = max(1, SCORES // max(n_asking, len(queries_of), 1))
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                lengths, row, term, tf = postings(part.column("tokens"))
                weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[row] / mean))
                each = start[term + 1] - start[term]
                query = queries_of[np.repeat(start[term] - np.concatenate([[0], each.cumsum()[:-1]])[: len(term)], each) + np.arange(each.sum())]
                cells = np.bincount(np.repeat(row, each) * n_asking + query, np.repeat(weight, each), part.num_rows * n_asking)
                # Sums in any order differ in the last digits; the rank must not depend on them.
                cells = np.round(cells, 9)
                hit = np.flatnonzero(cells > 0)
                if best is not None:
                    hit = hit[cells[hit] >= least[hit % n_asking]]
                rows = pa.RecordBatch.from_arrays([pa.array(hit % n_asking), *(part.column(c).take(pa.array(hit // n_asking)) for c in ("chunk_id", "ord")), pa.array(cells[hit])], ["query", "chunk_id", "ord", "score"])
                best = pa.Table.from_batches([rows] if best is None else [*best.to_batches(), rows]).sort_by([("query", "ascending"), ("score", "descending"), ("ord", "ascending")], null_placement="at_start").combine_chunks()
                of = best.column("query").to_numpy()
                nth = np.arange(len(of)) - np.searchsorted(of, of)
                best = best.filter(pa.array(nth < k))
                # What a query's k-th best has, once it has so many, is the least that matters.
                least = np.zeros(n_asking)
                full = (nth == k - 1).nonzero()[0]
                least[of[full]] = best.column("score").to_numpy()[np.flatnonzero(nth[nth < k] == k - 1)]
        if best is not None:
            yield from best.to_batches()

    kinds = {f.name: f.dataType.simpleString() for f in corpus.schema}
    found = split.mapInArrow(score, f"query long, chunk_id {kinds['chunk_id']}, ord {kinds['ord']}, score double")
    names = queries.sparkSession.createDataFrame(list(enumerate(asking)), f"query long, query_id {queries.schema['query_id'].dataType.simpleString()}")
    best = top_k(found, k, [F.desc("score"), F.asc("ord")], "query").join(F.broadcast(names), "query")
    return best.select("query_id", "chunk_id", "rank", "score", "ord")


def _bm25_joined(corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """bm25_search by joins of postings with query terms.

    Only postings of terms that some query has are scored; one row of corpus
    statistics and the document frequencies of those terms join them.
    """
    wanted = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    # An empty term after the tokens stands for the chunk itself, so that one pass over the texts gives postings, document frequencies and corpus statistics.
    asked = wanted.select("term").unionByName(queries.sparkSession.range(1).select(F.lit("").alias("term"))).distinct()
    split = corpus.select("chunk_id", "ord", tokens(F.col("text")).alias("_tokens")).withColumn("dl", F.size("_tokens"))
    terms = split.select("chunk_id", "ord", "dl", F.explode(F.concat("_tokens", F.array(F.lit("")))).alias("term")).join(asked, "term", "left_semi")
    counts = terms.groupBy("chunk_id", "ord", "dl", "term").agg(F.count("*").alias("tf"))
    # No branch filters or prunes the counts in its own way: else Spark would tokenise the corpus once for each.
    frequency = counts.groupBy("term").agg(F.count_if(F.col("tf") > 0).alias("df"), F.sum("tf").alias("_n"), F.sum(F.col("dl") * F.col("tf")).alias("_length"))
    whole = lambda c: F.max(F.when(F.col("term") == "", F.col(c)))
    totals = frequency.agg(whole("_n").alias("n"), (whole("_length") / whole("_n")).alias("avgdl"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = counts.join(frequency.select("term", "df"), "term").crossJoin(F.broadcast(totals)).select("term", "chunk_id", "ord", weight.alias("weight"))
    # Sums in any order differ in the last digits; the rank must not depend on them.
    score = F.round(F.sum("weight"), 9).alias("score")
    found = scored.join(wanted, "term").groupBy("query_id", "chunk_id", "ord").agg(score).where("score > 0")
    return top_k(found, k, [F.desc("score"), F.asc("ord")]).select("query_id", "chunk_id", "rank", "score", "ord")


def containing(texts: DataFrame, passages: DataFrame, key: str, words: int = 4) -> DataFrame:
    """Rows of texts (key, text, ...) beside each passage (passage, ...) that they contain; null texts and passages match nothing.

    A text that contains a passage has its words from the second on, up to the last but one, as whole words: the hash of the first ``words`` of these, or of
    all if they are fewer, joins the two. Only keys and hashes are exploded and shuffled; the texts of the hits are fetched by their key, and the passage itself is
    looked for. A passage of one or two words, of which no word need be whole in a text, is compared with every text.
    """
    split = lambda c: F.split(F.col(c), r"[\x20\x09-\x0D]+")
    hashed = lambda w, at, n: F.xxhash64(n, F.concat_ws(" ", F.slice(w, at, n)))
    keyed = passages.where(F.col("passage").isNotNull()).withColumn("_words", split("passage"))
    keyed = keyed.withColumn("_size", F.least(F.lit(words), F.greatest(F.size("_words") - 2, F.lit(0))))
    # At most words + 1 numbers: the lengths of grams that some passage needs.
    sizes = sorted(r[0] for r in keyed.select("_size").distinct().collect())
    asked = keyed.where("_size > 0").withColumn("_gram", hashed(F.col("_words"), F.lit(2), F.col("_size"))).drop("_words", "_size")
    split_texts = texts.select(F.col(key).alias("_of"), split("text").alias("_words"))

    def grams_of(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("_words") - (n - 1)))
        return F.transform(starts, lambda i: hashed(F.col("_words"), i, F.lit(n)))

    grams = [grams_of(n) for n in sizes if n]
    out = texts.join(keyed.where("_size = 0").drop("_words", "_size"), F.contains(texts["text"], F.col("passage"))) if 0 in sizes or not sizes else None
    if grams:
        met = split_texts.select("_of", F.explode(F.concat(*grams)).alias("_gram")).join(asked.select("_gram").distinct(), "_gram", "left_semi").distinct()
        found = texts.join(met, F.col(key).eqNullSafe(F.col("_of"))).drop("_of").join(asked, "_gram").drop("_gram").where(F.contains("text", "passage"))
        out = found if out is None else found.unionByName(out)
    return out


def cosine_neighbours(corpus: DataFrame, queries: DataFrame, k: int, drop_self: bool = False) -> DataFrame:
    """Exact top k by cosine of a stated set of queries (query_id, vector) against a corpus (chunk_id, ord, vector).

    Queries and corpus are dealt into blocks, and each pair of blocks meets in one tile, which answers with its own best k of each query, so no
    pair beyond these leaves a task, and nothing but two counts reaches the driver. A zero vector has cosine 0.
    """
    asked_blocks, held_blocks = (max(1, -(-df.count() // QUERY_BLOCK)) for df in (queries, corpus))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    asked = queries.select("query_id", F.col("vector").alias("asked"), own("query_id", asked_blocks).alias("i")).withColumn("j", every(held_blocks))
    held = corpus.select("chunk_id", "ord", "vector", own("chunk_id", held_blocks).alias("j")).withColumn("i", every(asked_blocks))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        names, chunk, place = (t.column(c).to_numpy() for t, c in ((left, "query_id"), (right, "chunk_id"), (right, "ord")))
        if not len(names) or not len(chunk):
            return pa.table({c: pa.array([], t) for c, t in (("query_id", pa.int64()), ("chunk_id", pa.int64()), ("ord", pa.int64()), ("score", pa.float64()))})
        scores = np.round(unit(matrix(left, "asked")) @ unit(matrix(right)).T, 9)
        if drop_self:
            scores[names[:, None] == chunk[None, :]] = -np.inf
        order = np.lexsort((np.broadcast_to(place, scores.shape), -scores), axis=1)[:, :k]
        best = np.take_along_axis(scores, order, axis=1)
        real = best > -np.inf
        return pa.table({"query_id": np.repeat(names, order.shape[1])[real.ravel()], "chunk_id": chunk[order][real], "ord": place[order][real], "score": best[real]})

    tiles = asked.groupBy("i", "j").cogroup(held.groupBy("i", "j"))
    out = tiles.applyInArrow(search, "query_id long, chunk_id long, ord long, score double")
    return top_k(out, k, [F.desc("score"), F.asc("ord")]).select("query_id", "chunk_id", "rank", "score")


def matrix(table: pa.Table, name: str = "vector") -> np.ndarray:
    """The vectors of a column as rows."""
    return pa.concat_arrays(table.column(name).chunks).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(table.num_rows, -1)


def unit(rows: np.ndarray) -> np.ndarray:
    """The rows at length 1; zero rows stay."""
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def _pair_tiles(corpus: DataFrame, block: int) -> GroupedData:
    """The vectors (chunk_id, vector, own) of every two blocks of a corpus, by (i, j)."""
    n = corpus.count()
    blocks = max(1, -(-n // max(block, LARGE_PAIR_BLOCK)), min(-(-n // block), PAIR_BLOCKS))
    own = F.pmod(F.xxhash64("chunk_id"), F.lit(blocks)).alias("own")
    dealt = corpus.select("chunk_id", "vector", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    return dealt.select("chunk_id", "vector", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).groupBy("i", "j")


def _pairs_of_tile(key: tuple[pa.Scalar, ...], tile: pa.Table, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in the tile of pairs of different ids, a part after the other. A block with itself has each pair once, its lesser id first."""
    ids, side = (tile.column(c).to_numpy() for c in ("chunk_id", "own"))
    units = unit(matrix(tile))
    left, right = (np.flatnonzero(side == k.as_py()) for k in key)
    for lo in range(0, len(left), PAIR_ROWS):
        part = left[lo : lo + PAIR_ROWS]
        x, y = np.nonzero(np.round(units[part] @ units[right].T, 9) >= least)
        x, y = part[x], right[y]
        keep = ids[x] < ids[y] if key[0] == key[1] else ids[x] != ids[y]
        yield x[keep], y[keep]


def cosine_pairs(corpus: DataFrame, least: float, tolerance: float = 1e-4, block: int = PAIR_BLOCK) -> DataFrame:
    """All pairs (a < b) of chunks of a corpus (chunk_id, vector) whose cosine is at least ``least``.

    Chunks are dealt into blocks by a hash of the id, and every two blocks meet in one tile; nothing reaches the
    driver but the number of rows. Vectors are sent once for each block, so this grows with the square of the corpus.
    """

    def meet(key: tuple[pa.Scalar, ...], tile: pa.Table) -> pa.Table:
        ids = tile.column("chunk_id").to_numpy()
        found = [(ids[x], ids[y]) for x, y in _pairs_of_tile(key, tile, least - tolerance)] or [(ids[:0], ids[:0])]
        a, b = (np.concatenate(c) for c in zip(*found, strict=True))
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return _pair_tiles(corpus, block).applyInArrow(meet, "a long, b long").distinct()


def cosine_links(corpus: DataFrame, least: float, tolerance: float = 1e-4, block: int = PAIR_BLOCK) -> DataFrame:
    """Some of cosine_pairs that connect the same chunks: a tile joins those that are connected within it to the first of them, so it has fewer rows than vectors."""

    def meet(key: tuple[pa.Scalar, ...], tile: pa.Table) -> pa.Table:
        ids = tile.column("chunk_id").to_numpy()
        first = np.arange(len(ids))
        for x, y in _pairs_of_tile(key, tile, least - tolerance):
            first = joined_places(first, x, y)
        a, b = ids, ids[first]
        return pa.table({"a": np.minimum(a, b)[a != b], "b": np.maximum(a, b)[a != b]})

    return _pair_tiles(corpus, block).applyInArrow(meet, "a long, b long").distinct()


def joined_places(first: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The first place of each one's component (``first``, of itself at least) when the places x and y are linked too."""
    first = first.copy()
    while True:
        a, b = first[x], first[y]
        apart = a != b
        if not apart.any():
            return first
        x, y, a, b = x[apart], y[apart], a[apart], b[apart]
        np.minimum.at(first, np.maximum(a, b), np.minimum(a, b))
        while (first[first] != first).any():
            first = first[first]


def knn_score(cosine: Column) -> Column:
    return (1 + cosine) / 2


def rrf(routes: list[DataFrame], limit: int, key: str = "chunk_id", rrf_k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of ranked tables; ties by where a key was seen first. Repeats in a route add up."""
    both = None
    for route, ranked in enumerate(routes):
        rows = ranked.select("query_id", F.col(key).alias("key"), "rank", F.lit(route).alias("route"))
        both = rows if both is None else both.unionByName(rows)
    # A sum of few terms in a fixed order: the terms of a key are sorted first.
    terms = F.sort_array(F.collect_list(1 / (F.lit(float(rrf_k)) + F.col("rank"))))
    fused = both.groupBy("query_id", "key").agg(F.round(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x), 12).alias("score"), F.min(F.struct("route", "rank")).alias("seen"))
    return top_k(fused, limit, [F.desc("score"), F.asc("seen")]).select("query_id", F.col("key").alias(key), "rank", "score")


def score_gate(ranked: DataFrame, least: float) -> DataFrame:
    return ranked.where(F.col("score") >= least)


def collapse_by_parent(ranked: DataFrame, k: int) -> DataFrame:
    """The first hit of each parent, hits without one all stay; ranked again, at most k."""
    group = F.coalesce(F.nullif(F.col("parent_id"), F.lit("")), F.concat(F.lit("#"), F.col("chunk_id").cast("string")))
    first = ranked.withColumn("_nth", F.row_number().over(Window.partitionBy("query_id", group).orderBy("rank"))).where("_nth = 1").drop("_nth")
    return top_k(first.withColumnRenamed("rank", "raw_rank"), k, [F.asc("raw_rank")])


def final_search(ranked: DataFrame, k: int, least: float) -> DataFrame:
    """Recall of min(3 k, 15), gate, collapse to k; with the diagnostics of each step on every row."""
    recalled = ranked.where(F.col("rank") <= min(RECALL_FACTOR * k, RECALL_MOST))
    gated = score_gate(recalled, least)
    raw = recalled.groupBy("query_id").agg(F.count("*").alias("raw_hits"), F.max("score").alias("raw_top_score"))
    parents = gated.where("parent_id <> ''").groupBy("query_id", "parent_id").agg(F.count("*").alias("n"))
    collapsed = parents.groupBy("query_id").agg(F.count_if(F.col("n") > 1).alias("collapsed_parents"))
    kept = gated.groupBy("query_id").agg(F.count("*").alias("gated_hits"))
    out = collapse_by_parent(gated, k).join(raw, "query_id").join(kept, "query_id").join(collapsed, "query_id", "left")
    return out.withColumn("collapsed_parents", F.coalesce("collapsed_parents", F.lit(0)))


def rejection_signals(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, hits, top1, gap, coverage) of every query (query_id, query); hits also have a text."""
    first, second = F.max(F.when(F.col("rank") == 1, F.col("score"))), F.max(F.when(F.col("rank") == 2, F.col("score")))
    best = F.max(lexical_coverage(F.col("query"), F.col("text")))
    found = queries.join(hits, "query_id").groupBy("query_id").agg(F.count("*").alias("hits"), first.alias("top1"), (first - second).alias("gap"), best.alias("coverage"))
    return queries.select("query_id").join(found, "query_id", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))


def rejection_decide(signals: DataFrame, top1: float | None = None, gap: float | None = None, coverage: float | None = None) -> DataFrame:
    """Adds the reasons for rejecting: no hits, or each configured signal strictly below its least value."""
    reasons = [F.when(F.col("hits") == 0, "no_hits")]
    for name, least in (("top1", top1), ("gap", gap), ("coverage", coverage)):
        if least is not None:
            reasons.append(F.when(F.col(name) < least, f"low_{name}"))
    found = F.array_compact(F.array(*reasons))
    return signals.withColumn("reasons", F.array_join(found, ",")).withColumn("rejected", F.size(found) > 0)


def product_search(products: DataFrame, terms: list[str], query: str, k: int) -> DataFrame:
    """Ranked products (id, name, category, text): the strongest place of a term, then shared bigrams."""
    from tessera.functions.text import bigrams

    def strength(t: str) -> Column:
        return F.when(F.lower("category") == t, 4).when(F.lower("name").contains(t), 3).when(F.lower("text").contains(t), 2).otherwise(0)

    wanted = F.array_distinct(bigrams(F.lit(query.lower())))
    strong = F.greatest(*[strength(t.lower()) for t in terms], F.lit(0), F.lit(0))
    overlap = F.size(F.array_intersect(wanted, bigrams(F.lower(F.concat_ws(" ", "name", "text")))))
    category = F.size(F.array_intersect(wanted, bigrams(F.lower("category"))))
    least = max(1, max(0, len(set(query.lower()[i : i + 2] for i in range(len(query) - 1)))) // 3)
    scored = products.select("id", "name", strong.alias("strong"), overlap.alias("overlap"), (100 * strong + 10 * category + overlap).alias("score"))
    return scored.where((F.col("strong") > 0) | (F.col("overlap") >= least)).orderBy(F.desc("score"), "id").limit(k)


def usable_subqueries(rewrites: DataFrame, most: int = 3) -> DataFrame:
    """(query_id, subqueries): the query first, then its rewrites, trimmed, distinct, at most three."""
    every = F.concat(F.array(F.col("query")), F.coalesce("rewrites", F.array().cast("array<string>")))
    return rewrites.select("query_id", F.slice(F.array_distinct(F.filter(F.transform(every, lambda q: F.trim(q)), lambda q: q != "")), 1, most).alias("subqueries"))


def apply_rerank(ranked: DataFrame, scores: DataFrame, k: int) -> DataFrame:
    """Order by supplied scores (query_id, chunk_id, rerank_score); unavailable if fewer than min(k, hits) are valid.

    Scores that repeat a pair or aren't finite don't count. Hits of an unavailable query keep their order and are marked degraded.
    """
    finite = ~F.isnan("rerank_score") & (F.abs("rerank_score") < float("inf"))
    once = scores.where(finite).groupBy("query_id", "chunk_id").agg(F.first("rerank_score").alias("rerank_score"))
    joined = ranked.join(once, ["query_id", "chunk_id"], "left")
    whole = Window.partitionBy("query_id")
    need = F.least(F.lit(k), F.count("*").over(whole))
    joined = joined.withColumn("degraded", F.count("rerank_score").over(whole) < need)
    order = Window.partitionBy("query_id").orderBy(F.when(~F.col("degraded"), F.col("rerank_score")).desc_nulls_last(), "rank")
    out = joined.withColumn("_new", F.row_number().over(order)).where(F.col("degraded") | F.col("rerank_score").isNotNull())
    return out.where(F.col("_new") <= k).drop("rank").withColumnRenamed("_new", "rank")
