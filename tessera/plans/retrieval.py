"""Queries for search and its evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import lexical_coverage
from tessera.operators import evaluation as ev
from tessera.operators import retrieval as rt
from tessera.plans._tables import Query, benchmark_queries, corpus, table, vectors

TOKENS_SQL = "list_transform(regexp_extract_all({0}, '[0-9A-Za-z]+'), lambda x: lower(x))"


def _hits(spark: SparkSession, sf: str, k: int = 15) -> DataFrame:
    return rt.bm25_search(corpus(spark, sf), benchmark_queries(spark, sf), k)


def _neighbours(spark: SparkSession, sf: str, k: int) -> DataFrame:
    every = vectors(spark, sf)
    asked = every.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), "vector")
    return rt.cosine_neighbours(every, asked, k, drop_self=True)


def tokenize(spark: SparkSession, sf: str) -> DataFrame:
    return rt.token_counts(corpus(spark, sf))


def bm25_index(spark: SparkSession, sf: str) -> DataFrame:
    return rt.bm25_postings(corpus(spark, sf)).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"), F.max("dl").alias("longest"))


def bm25_search(spark: SparkSession, sf: str) -> DataFrame:
    return _hits(spark, sf, 10).select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


def cosine_knn(spark: SparkSession, sf: str) -> DataFrame:
    return _neighbours(spark, sf, 5).select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


def es_knn_score(spark: SparkSession, sf: str) -> DataFrame:
    return _neighbours(spark, sf, 3).select("query_id", "chunk_id", F.round(rt.knn_score(F.col("score")), 6).alias("es_score"), F.round(2 * rt.knn_score(F.col("score")) - 1, 6).alias("cosine"))


def chroma_knn(spark: SparkSession, sf: str) -> DataFrame:
    return _neighbours(spark, sf, 3).select("query_id", "chunk_id", F.round(1 - F.col("score"), 6).alias("distance"), F.round("score", 6).alias("score"))


def _routes(spark: SparkSession, sf: str) -> list[DataFrame]:
    near = _neighbours(spark, sf, 10)
    labels = vectors(spark, sf).select("chunk_id", "label")
    own = vectors(spark, sf).select(F.col("chunk_id").alias("query_id"), F.col("label").alias("own"))
    alike = near.join(labels, "chunk_id").join(own, "query_id").withColumn("same", (F.col("label") == F.col("own")).cast("int"))
    second = rt.top_k(alike.withColumnRenamed("rank", "before"), 10, [F.desc("same"), F.asc("before")]).select("query_id", "chunk_id", "rank")
    return [near, second]


def rrf_two_way(spark: SparkSession, sf: str) -> DataFrame:
    return rt.rrf(_routes(spark, sf), 5).select("query_id", "chunk_id", "rank", F.round("score", 9).alias("score"))


def rrf_multi_query(spark: SparkSession, sf: str) -> DataFrame:
    near, second = _routes(spark, sf)
    parent = lambda r: r.select("query_id", (F.col("chunk_id") % 25).alias("parent"), "rank")
    return rt.rrf([parent(near), parent(second)], 4, key="parent").select("query_id", "parent", "rank", F.round("score", 9).alias("score"))


def score_gate(spark: SparkSession, sf: str) -> DataFrame:
    return rt.score_gate(_neighbours(spark, sf, 10), 0.3).select("query_id", "chunk_id", "rank")


def _with_parents(spark: SparkSession, sf: str) -> DataFrame:
    parent = F.when(F.col("chunk_id") % 3 == 0, "").otherwise(F.concat(F.lit("p"), (F.col("chunk_id") % 20).cast("string")))
    return _neighbours(spark, sf, 15).withColumn("parent_id", parent)


def collapse_by_parent(spark: SparkSession, sf: str) -> DataFrame:
    return rt.collapse_by_parent(_with_parents(spark, sf), 5).select("query_id", "chunk_id", "parent_id", "rank")


def final_search(spark: SparkSession, sf: str) -> DataFrame:
    return rt.final_search(_with_parents(spark, sf), 4, 0.2).select("query_id", "chunk_id", "rank", "raw_hits", "gated_hits", "collapsed_parents", F.round("raw_top_score", 6).alias("raw_top_score"))


def _signals(spark: SparkSession, sf: str) -> DataFrame:
    hits = _hits(spark, sf, 5).join(table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "text"), "chunk_id")
    asked = benchmark_queries(spark, sf).withColumnRenamed("text", "query")
    return rt.rejection_signals(asked, hits)


def rejection_signals(spark: SparkSession, sf: str) -> DataFrame:
    return _signals(spark, sf).select("query_id", "hits", F.round("top1", 6).alias("top1"), F.round("gap", 6).alias("gap"), F.round("coverage", 6).alias("coverage"))


def rejection_decide(spark: SparkSession, sf: str) -> DataFrame:
    return rt.rejection_decide(_signals(spark, sf), top1=30.0, gap=1.0, coverage=0.5).select("query_id", "reasons", "rejected")


def lexical_coverage_query(spark: SparkSession, sf: str) -> DataFrame:
    texts = table(spark, sf, "conversations")
    first = texts.where("turn = 0").select("conv_id", F.col("text").alias("opening"))
    return texts.where("turn > 0").join(first, "conv_id").select("conv_id", "turn", F.round(lexical_coverage(F.col("opening"), F.col("text")), 9).alias("coverage"))


def _cases(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark passages as queries; relevant are the documents that hold the passage."""
    passages = benchmark_queries(spark, sf)
    inside = rt.containing(table(spark, sf, "documents").select("doc_id", "text"), passages.withColumnRenamed("text", "passage"), "doc_id")
    expected = inside.groupBy("query_id").agg(F.sort_array(F.collect_list("doc_id")).alias("expected"))
    return passages.select("query_id").join(expected, "query_id", "left").withColumn("expected", F.coalesce("expected", F.array().cast("array<bigint>")))


def _metrics(spark: SparkSession, sf: str) -> DataFrame:
    return ev.case_metrics(_cases(spark, sf), _hits(spark, sf, 10).withColumnRenamed("chunk_id", "key"), 5)


def case_metrics(spark: SparkSession, sf: str) -> DataFrame:
    m = _metrics(spark, sf)
    return m.select("query_id", "positive", *[F.round(c, 9).alias(c) for c in ("recall", "mrr", "ndcg")])


def retrieval_report(spark: SparkSession, sf: str) -> DataFrame:
    m = _metrics(spark, sf)
    tags = m.select("query_id", F.explode(F.array_compact(F.array(F.lit("all"), F.when(F.col("positive"), "positive").otherwise("negative"), F.when(F.col("query_id") % 2 == 0, "even")))).alias("tag"))
    return ev.strata_report(m, tags).select("tag", "cases", *[F.round(c, 9).alias(c) for c in ("recall", "mrr", "ndcg")])


def threshold_calibration(spark: SparkSession, sf: str) -> DataFrame:
    cases = _cases(spark, sf)
    relevant = cases.select("query_id", F.explode("expected").alias("chunk_id"), F.lit(True).alias("relevant"))
    hits = _hits(spark, sf, 10).join(relevant, ["query_id", "chunk_id"], "left").withColumn("relevant", F.coalesce("relevant", F.lit(False)))
    steps = spark.range(0, 12).select((F.col("id") * 10.0).alias("threshold"))
    sweep = ev.threshold_sweep(hits, cases.select("query_id", F.size("expected").alias("n_expected")), steps, 5)
    return sweep.select("threshold", F.round("recall", 9).alias("recall"), F.round("rejected", 9).alias("rejected"))


QUERIES: dict[str, Query] = {
    "tokenize": tokenize, "bm25_index": bm25_index, "bm25_search": bm25_search, "cosine_knn": cosine_knn, "es_knn_score": es_knn_score, "chroma_knn": chroma_knn,
    "rrf_two_way": rrf_two_way, "rrf_multi_query": rrf_multi_query, "score_gate": score_gate, "collapse_by_parent": collapse_by_parent, "final_search": final_search,
    "rejection_signals": rejection_signals, "rejection_decide": rejection_decide, "lexical_coverage": lexical_coverage_query,
    "case_metrics": case_metrics, "retrieval_report": retrieval_report, "threshold_calibration": threshold_calibration,
}

_BM25 = f"""
terms AS (SELECT doc_id, unnest({TOKENS_SQL.format('text')}) AS term FROM documents),
tfs AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
lens AS (SELECT doc_id, len({TOKENS_SQL.format('text')}) AS dl FROM documents),
stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lens),
dfs AS (SELECT term, count(*) AS df FROM tfs GROUP BY term),
asked AS (SELECT DISTINCT item_id AS query_id, unnest({TOKENS_SQL.format('text')}) AS term FROM benchmark),
scored AS (
    SELECT query_id, doc_id AS chunk_id, round(sum(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 9) AS score
    FROM asked JOIN tfs USING (term) JOIN dfs USING (term) JOIN lens USING (doc_id), stats GROUP BY ALL
),
ranked AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM scored WHERE score > 0)
"""
_KNN = """
pairs AS (
    SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 9) AS score, q.label AS own, c.label AS label
    FROM embeddings q, embeddings c WHERE q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
),
near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM pairs)
"""
_ROUTES = _KNN + """,
ten AS (SELECT * FROM near WHERE rank <= 10),
second AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY (label = own)::INT DESC, rank)::INT AS rank FROM ten)
"""
_PARENTS = _KNN + """,
parents AS (SELECT query_id, chunk_id, rank, score, CASE WHEN chunk_id % 3 = 0 THEN '' ELSE 'p' || (chunk_id % 20) END AS parent_id FROM near WHERE rank <= 15)
"""
_CASES = """
expected AS (SELECT b.item_id AS query_id, list(d.doc_id) FILTER (WHERE d.doc_id IS NOT NULL) AS expected FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY ALL),
cases AS (SELECT query_id, coalesce(expected, []) AS expected, coalesce(len(expected), 0) AS n FROM expected)
"""
_METRICS = _BM25 + "," + _CASES + """,
hits AS (SELECT query_id, chunk_id, rank FROM ranked WHERE rank <= 10),
gains AS (
    SELECT query_id, count(*) FILTER (WHERE rank <= 5) AS covered, min(rank) AS best, sum(1 / log2(rank + 1)) FILTER (WHERE rank <= 5) AS dcg
    FROM hits JOIN (SELECT query_id, unnest(expected) AS chunk_id FROM cases) USING (query_id, chunk_id) GROUP BY query_id
),
metrics AS (
    SELECT c.query_id, n > 0 AS positive, CASE WHEN n > 0 THEN coalesce(covered, 0) / n END AS recall, CASE WHEN n > 0 THEN coalesce(1.0::DOUBLE / best, 0) END AS mrr,
           CASE WHEN n > 0 THEN coalesce(dcg / list_sum(list_transform(range(1, least(5, n) + 1), lambda i: 1 / log2(i + 1))), 0) END AS ndcg
    FROM cases c LEFT JOIN gains USING (query_id)
)
"""
_SIGNALS = _BM25 + f""",
texts AS (
    SELECT b.item_id AS query_id, list_distinct({TOKENS_SQL.format('b.text')}) AS q, r.rank, r.score, list_distinct({TOKENS_SQL.format('d.text')}) AS d
    FROM benchmark b LEFT JOIN (SELECT * FROM ranked WHERE rank <= 5) r ON r.query_id = b.item_id LEFT JOIN documents d ON d.doc_id = r.chunk_id
),
signals AS (
    SELECT query_id, count(rank) AS hits, max(score) FILTER (WHERE rank = 1) AS top1, max(score) FILTER (WHERE rank = 1) - max(score) FILTER (WHERE rank = 2) AS gap,
           max(CASE WHEN len(q) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(q, d)) / len(q) END) FILTER (WHERE rank IS NOT NULL) AS coverage
    FROM texts GROUP BY query_id
)
"""

ORACLE_SQL: dict[str, str] = {
    "tokenize": f"SELECT token, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest({TOKENS_SQL.format('text')}) AS token FROM documents) GROUP BY token",
    "bm25_index": f"WITH {_BM25} SELECT term, count(*) AS df, sum(tf)::BIGINT AS tf, max(dl) AS longest FROM tfs JOIN lens USING (doc_id) GROUP BY term",
    "bm25_search": f"WITH {_BM25} SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM ranked WHERE rank <= 10",
    "cosine_knn": f"WITH {_KNN} SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM near WHERE rank <= 5",
    "es_knn_score": f"WITH {_KNN} SELECT query_id, chunk_id, round((1 + score) / 2, 6) AS es_score, round(2 * ((1 + score) / 2) - 1, 6) AS cosine FROM near WHERE rank <= 3",
    "chroma_knn": f"WITH {_KNN} SELECT query_id, chunk_id, round(1 - score, 6) AS distance, round(score, 6) AS score FROM near WHERE rank <= 3",
    "rrf_two_way": f"""WITH {_ROUTES}, fused AS (
        SELECT query_id, chunk_id, round(sum(1 / (60 + rank)), 12) AS score, min((route, rank)) AS seen
        FROM (SELECT query_id, chunk_id, rank, 0 AS route FROM ten UNION ALL SELECT query_id, chunk_id, rank, 1 FROM second) GROUP BY ALL
    ), placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen)::INT AS rank FROM fused)
    SELECT query_id, chunk_id, rank, round(score, 9) AS score FROM placed WHERE rank <= 5""",
    "rrf_multi_query": f"""WITH {_ROUTES}, fused AS (
        SELECT query_id, chunk_id % 25 AS parent, round(sum(1 / (60 + rank)), 12) AS score, min((route, rank)) AS seen
        FROM (SELECT query_id, chunk_id, rank, 0 AS route FROM ten UNION ALL SELECT query_id, chunk_id, rank, 1 FROM second) GROUP BY ALL
    ), placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen)::INT AS rank FROM fused)
    SELECT query_id, parent, rank, round(score, 9) AS score FROM placed WHERE rank <= 4""",
    "score_gate": f"WITH {_KNN} SELECT query_id, chunk_id, rank FROM near WHERE rank <= 10 AND score >= 0.3",
    "collapse_by_parent": f"""WITH {_PARENTS}, firsts AS (
        SELECT *, row_number() OVER (PARTITION BY query_id, CASE WHEN parent_id = '' THEN '#' || chunk_id ELSE parent_id END ORDER BY rank) AS nth FROM parents
    ), placed AS (SELECT query_id, chunk_id, parent_id, row_number() OVER (PARTITION BY query_id ORDER BY rank)::INT AS place FROM firsts WHERE nth = 1)
    SELECT query_id, chunk_id, parent_id, place AS rank FROM placed WHERE place <= 5""",
    "final_search": f"""WITH {_PARENTS}, recalled AS (SELECT * FROM parents WHERE rank <= 12), gated AS (SELECT * FROM recalled WHERE score >= 0.2),
    firsts AS (SELECT *, row_number() OVER (PARTITION BY query_id, CASE WHEN parent_id = '' THEN '#' || chunk_id ELSE parent_id END ORDER BY rank) AS nth FROM gated),
    placed AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rank)::INT AS rank FROM firsts WHERE nth = 1),
    raw AS (SELECT query_id, count(*) AS raw_hits, round(max(score), 6) AS raw_top_score FROM recalled GROUP BY query_id),
    kept AS (SELECT query_id, count(*) AS gated_hits FROM gated GROUP BY query_id),
    twice AS (SELECT query_id, count(*) AS collapsed_parents FROM (SELECT query_id, parent_id FROM gated WHERE parent_id <> '' GROUP BY ALL HAVING count(*) > 1) GROUP BY query_id)
    SELECT query_id, chunk_id, rank, raw_hits, gated_hits, coalesce(collapsed_parents, 0) AS collapsed_parents, raw_top_score
    FROM placed JOIN raw USING (query_id) JOIN kept USING (query_id) LEFT JOIN twice USING (query_id) WHERE rank <= 4""",
    "rejection_signals": f"WITH {_SIGNALS} SELECT query_id, hits, round(top1, 6) AS top1, round(gap, 6) AS gap, round(coverage, 6) AS coverage FROM signals",
    "rejection_decide": f"""WITH {_SIGNALS}, listed AS (
        SELECT query_id, list_filter([CASE WHEN hits = 0 THEN 'no_hits' END, CASE WHEN top1 < 30 THEN 'low_top1' END, CASE WHEN gap < 1 THEN 'low_gap' END, CASE WHEN coverage < 0.5 THEN 'low_coverage' END], lambda x: x IS NOT NULL) AS r FROM signals
    ) SELECT query_id, array_to_string(r, ',') AS reasons, len(r) > 0 AS rejected FROM listed""",
    "lexical_coverage": f"""WITH grams AS (SELECT conv_id, turn, list_distinct({TOKENS_SQL.format('text')}) AS g FROM conversations), opening AS (SELECT conv_id, g AS q FROM grams WHERE turn = 0)
    SELECT conv_id, turn, CASE WHEN len(q) = 0 THEN 0.0::DOUBLE ELSE round(len(list_intersect(q, g)) / len(q), 9) END AS coverage FROM grams JOIN opening USING (conv_id) WHERE turn > 0""",
    "case_metrics": f"WITH {_METRICS} SELECT query_id, positive, round(recall, 9) AS recall, round(mrr, 9) AS mrr, round(ndcg, 9) AS ndcg FROM metrics",
    "retrieval_report": f"""WITH {_METRICS}, tagged AS (
        SELECT *, unnest(list_filter(['all', CASE WHEN positive THEN 'positive' ELSE 'negative' END, CASE WHEN query_id % 2 = 0 THEN 'even' END], lambda x: x IS NOT NULL)) AS tag FROM metrics
    ) SELECT tag, count(*) AS cases, round(avg(recall), 9) AS recall, round(avg(mrr), 9) AS mrr, round(avg(ndcg), 9) AS ndcg FROM tagged GROUP BY tag""",
    "threshold_calibration": f"""WITH {_BM25}, {_CASES}, steps AS (SELECT unnest(range(0, 12)) * 10.0::DOUBLE AS threshold),
    gated AS (SELECT threshold, query_id, chunk_id, row_number() OVER (PARTITION BY threshold, query_id ORDER BY rank) AS r FROM ranked, steps WHERE rank <= 10 AND score >= threshold),
    found AS (SELECT threshold, query_id, count(*) AS hits, count(*) FILTER (WHERE list_contains(expected, chunk_id)) AS covered FROM gated JOIN cases USING (query_id) WHERE r <= 5 GROUP BY ALL)
    SELECT threshold, round(avg(CASE WHEN n > 0 THEN coalesce(covered, 0) / n END), 9) AS recall, round(avg(CASE WHEN n = 0 THEN (hits IS NULL)::INT END), 9) AS rejected
    FROM cases CROSS JOIN steps LEFT JOIN found USING (threshold, query_id) GROUP BY threshold""",
}
