"""The whole online search for a batch of questions: fusion, gates, rejection, fences and diagnostics, failing closed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.safety import fence_taint
from tessera.operators.lifecycle import evidence_diagnostics, final_multi_search
from tessera.operators.retrieval import rejection_decide, rejection_signals

#: Results of a question: fixed values for none named and for the most.
USUAL, MOST = 3, 5


def search_knowledge(
    questions: DataFrame, routes: DataFrame, chunks: DataFrame, k: int | None = None, least: float | None = None,
    top1: float | None = None, gap: float | None = None, coverage: float | None = None, fail_closed: bool = True,
) -> DataFrame:
    """One row for each question (question, text) with its results, or why there are none.

    ``routes`` are the ranked hits of each question's queries (question, query, chunk_id, parent_id, rank, score, degraded), ``chunks`` have (chunk_id, text, source).
    Returns (question, success, error, results, n_items, tainted, top1, gap, sources); results are at most k (1 to 5) structs in order, and empty if there is an error:

    * ``empty_query``: the text is null or blank;
    * ``reranker_unavailable``: a route was degraded (unless ``fail_closed`` is off);
    * ``retrieval_rejected:<first reason>``: a question of one query, whose scores mean something, misses one of the least values top1, gap and coverage, or has no hits.

    ``least`` gates hits only while none of those three is set, and never those of degraded routes. Results that hold an injection are marked and their texts withheld;
    they speak for nothing in the figures. A question without hits and without least values succeeds with no results. Results of a chunk that is not in ``chunks`` have an empty text.
    """
    k = max(1, min(int(k or USUAL), MOST))
    joint = any(signal is not None for signal in (top1, gap, coverage))
    kinds = routes.groupBy("question").agg((F.count_distinct("query") == 1).alias("_single"), F.bool_or("degraded").alias("_degraded"))
    gated = routes if joint or least is None else routes.where(F.col("degraded") | (F.col("score") >= least))
    fused = final_multi_search(gated, k, float("-inf")).drop("degraded", "queries").join(kinds, "question")
    scores = gated.groupBy("question", "chunk_id").agg(F.max("score").alias("_score"))
    texts = chunks.select("chunk_id", F.col("text").alias("_text"), F.col("source").alias("_source"))
    # At most k rows a question meet the chunks.
    hits = fused.join(scores, ["question", "chunk_id"]).join(texts, "chunk_id", "left").withColumn("_text", F.coalesce("_text", F.lit("")))
    hits = hits.select(F.col("question").alias("query_id"), "chunk_id", "rank", F.when(F.col("_single"), F.col("_score")).otherwise(F.col("fused")).alias("score"), F.col("_source").alias("source"), F.col("_text").alias("text"))

    fenced = hits.withColumn("_", fence_taint(F.col("text"), F.col("text")))
    items = fenced.select("query_id", "chunk_id", "rank", "score", "source", F.col("_.tainted").alias("tainted"), F.col("_.text").alias("text"))
    results = items.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "chunk_id", "source", "tainted", "text"))).alias("_results"))
    figures = evidence_diagnostics(items.select("query_id", "rank", "score", "source", "tainted"))
    asked = questions.select(F.col("question").alias("query_id"), F.col("text").alias("query"))
    decided = rejection_decide(rejection_signals(asked, hits), top1, gap, coverage).select("query_id", "rejected", F.substring_index("reasons", ",", 1).alias("_reason"))

    out = asked.join(kinds.withColumnRenamed("question", "query_id"), "query_id", "left").join(decided, "query_id").join(results, "query_id", "left").join(figures, "query_id", "left")
    degraded = F.coalesce("_degraded", F.lit(False))
    error = F.when(F.btrim(F.coalesce("query", F.lit(""))) == "", "empty_query")
    if fail_closed:
        error = error.when(degraded, "reranker_unavailable")
    if joint:
        error = error.when(~degraded & F.coalesce("_single", F.lit(True)) & F.col("rejected"), F.concat(F.lit("retrieval_rejected:"), F.col("_reason")))
    nothing = F.array().cast(results.schema["_results"].dataType)
    return out.withColumn("error", error).select(
        F.col("query_id").alias("question"), F.col("error").isNull().alias("success"), "error", F.when(F.col("error").isNull(), F.coalesce("_results", nothing)).otherwise(nothing).alias("results"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.coalesce("tainted", F.lit(0).cast("long")).alias("tainted"), "top1", "gap", "sources",
    )
