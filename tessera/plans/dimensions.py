"""Queries of scores by dimension, recall by stratum and decisions before publishing, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import dimensions as dim
from tessera.plans._tables import Query, messages, table


def _words(*words):
    return F.array(*map(F.lit, words)).cast("array<string>")


def tool_metrics(spark, sf):
    users = table(spark, sf, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("called"), F.count("*").alias("n"))
    wanted = F.when(F.col("user_id") % 3 == 1, _words("click", "none")).when(F.col("user_id") % 3 == 2, _words("click", "click", "view")).otherwise(_words())
    least = F.when(F.col("user_id") % 4 > 0, F.col("user_id") % 7)
    return users.select("user_id", F.round(dim.tool_accuracy(wanted, F.col("called")), 6).alias("accuracy"), F.round(dim.tool_efficiency(least, F.col("n")), 6).alias("efficiency"))


def intent_match(spark, sf):
    c = table(spark, sf, "conversations")
    wanted = F.when(F.col("turn") % 3 > 0, F.when(F.col("conv_id") % 2 == 0, "user").otherwise("assistant"))
    return c.groupBy(dim.same(wanted, F.col("role")).alias("score")).agg(F.count("*").alias("n"))


def _replies(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit(" 1,000.50"))).otherwise(F.col("text")).alias("reply"))


def keyword_coverage(spark, sf):
    wanted = F.when(F.col("doc_id") % 5 > 0, _words("data", "1000")).otherwise(_words())
    return _replies(spark, sf).select("doc_id", dim.keyword_coverage(wanted, F.col("reply")).alias("coverage"))


def sensitive_leakage(spark, sf):
    forbidden = F.when(F.col("doc_id") % 3 > 0, _words("1000.5", "model")).otherwise(_words())
    return _replies(spark, sf).select("doc_id", dim.leak_free(forbidden, F.col("reply")).alias("score"))


def citation_check(spark, sf):
    k = F.col("event_id")
    wanted = F.when(k % 3 > 0, _words("docs/A.md", "b")).otherwise(_words())
    matched = F.when(k % 4 == 1, _words("a.txt")).when(k % 4 == 2, _words("A", "x/B.PDF")).when(k % 4 == 3, _words())
    missing = F.when(k % 4 == 1, _words("z")).otherwise(_words())
    return table(spark, sf, "events").groupBy(dim.citation_score(wanted, k % 5 == 0, matched, missing).alias("score")).agg(F.count("*").alias("n"))


def stratum_recall(spark, sf):
    k, lang, source = F.col("doc_id"), F.coalesce("lang", F.lit("none")), F.concat(F.lit("from "), F.coalesce("source", F.lit("none")))
    cases = table(spark, sf, "documents").select(
        F.array_compact(F.array(F.when(k % 5 == 0, "timing"), F.when(k % 7 == 0, "condition"))).alias("tags"),
        F.when(k % 4 == 0, _words()).when(k % 4 == 1, F.array(lang)).otherwise(F.array(lang, source)).alias("expected"),
        F.array_compact(F.array(lang, F.when(k % 3 > 0, source), F.when(k % 10 == 0, "archive/x"))).alias("hits"), lang.alias("layer"),
    )
    return dim.recall_by_stratum(cases).select("stratum", "n", F.round("strict", 6).alias("strict"), F.round("loose", 6).alias("loose"))


def publish_dedup_matrix(spark, sf):
    k = F.col("event_id")
    side = lambda shift: F.struct((k % 5).cast("string").alias("path"), ((k + shift) % 3 == 0).alias("near"), ((k + shift) % 7 == 0).alias("authoritative"), (k % 10 / 10.0).alias("quality"))
    decision = dim.publish_decision(side(0), side(1), F.when(k % 2 == 0, "update").otherwise("new"), (k % 4).cast("string"), F.lit(0.5))
    return table(spark, sf, "events").groupBy(decision.alias("decision")).agg(F.count("*").alias("n"))


def turn_missing_final(spark, sf):
    return dim.unanswered(messages(spark, sf))


QUERIES: dict[str, Query] = {f.__name__: f for f in (tool_metrics, intent_match, keyword_coverage, sensitive_leakage, citation_check, stratum_recall, publish_dedup_matrix, turn_missing_final)}

_REPLIES = "r AS (SELECT doc_id, coalesce(text, '') || CASE WHEN doc_id % 2 = 0 THEN ' 1,000.50' ELSE '' END AS reply FROM documents)"

ORACLE_SQL: dict[str, str] = {
    "tool_metrics": """WITH u AS (SELECT user_id, bool_or(event_type = 'click')::INT AS c, bool_or(event_type = 'view')::INT AS v, bool_or(event_type = 'none')::INT AS z, count(*) AS n FROM events GROUP BY 1)
        SELECT user_id, round(CASE user_id % 3 WHEN 1 THEN (c + z) / 2 WHEN 2 THEN (2 * c + v) / 3 END, 6) AS accuracy, round(CASE WHEN user_id % 4 > 0 THEN least(1.0::DOUBLE, user_id % 7 / n) END, 6) AS efficiency FROM u""",
    "intent_match": "SELECT CASE WHEN turn % 3 > 0 THEN ((role = CASE WHEN conv_id % 2 = 0 THEN 'user' ELSE 'assistant' END)::INT)::DOUBLE END AS score, count(*) AS n FROM conversations GROUP BY 1",
    "keyword_coverage": f"WITH {_REPLIES} SELECT doc_id, CASE WHEN doc_id % 5 > 0 THEN (contains(reply, 'data')::INT + contains(replace(reply, ',', ''), '1000')::INT) / 2 END AS coverage FROM r",
    "sensitive_leakage": f"WITH {_REPLIES} SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN (NOT (contains(reply, 'model') OR contains(replace(reply, ',', ''), '1000.5')))::INT::DOUBLE END AS score FROM r",
    "citation_check": """SELECT CASE WHEN event_id % 3 = 0 AND event_id % 5 > 0 THEN NULL WHEN event_id % 4 = 0 OR (event_id % 5 = 0 AND event_id % 4 = 1) THEN 0::DOUBLE WHEN event_id % 3 = 0 THEN NULL
        ELSE CASE event_id % 4 WHEN 1 THEN 0.5::DOUBLE WHEN 2 THEN 1::DOUBLE ELSE 0::DOUBLE END END AS score, count(*) AS n FROM events GROUP BY 1""",
    "stratum_recall": """WITH c AS (SELECT doc_id, coalesce(lang, 'none') AS lang, doc_id % 4 AS m, doc_id % 4 < 2 OR doc_id % 3 > 0 AS every FROM documents),
        s AS (SELECT 'timing' AS stratum, every AND doc_id % 10 > 0 AS every, m FROM c WHERE doc_id % 5 = 0 UNION ALL SELECT 'condition', every, m FROM c WHERE doc_id % 7 = 0 AND m > 0
            UNION ALL SELECT 'multihop', every, m FROM c WHERE m > 1 UNION ALL SELECT 'layer:' || lang, every, m FROM c WHERE m > 0)
        SELECT stratum, count(*) AS n, round(avg(every::INT), 6) AS strict, round(avg((m > 0)::INT), 6) AS loose FROM s GROUP BY 1""",
    "publish_dedup_matrix": """SELECT CASE WHEN (event_id % 3 = 0 AND event_id % 7 = 0) OR ((event_id + 1) % 3 = 0 AND (event_id + 1) % 7 = 0) THEN 'duplicate'
        WHEN event_id % 3 = 0 THEN CASE WHEN event_id % 2 > 0 THEN 'duplicate' WHEN event_id % 5 <> event_id % 4 THEN 'target_changed' WHEN event_id % 10 > 5 THEN 'duplicate' ELSE 'replaced' END
        WHEN (event_id + 1) % 3 = 0 THEN 'answer_side' ELSE 'kept' END AS decision, count(*) AS n FROM events GROUP BY 1""",
    "turn_missing_final": "SELECT conv_id AS session, turn AS seq FROM conversations QUALIFY role = 'user' AND lead(role) OVER (PARTITION BY conv_id ORDER BY turn) IS DISTINCT FROM 'assistant'",
}
