"""Queries for gates, dataset checks, small joins, JSON records and ranked picks."""

from __future__ import annotations

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import chunking, claims, text
from tessera.operators import evaluation, memory, mining, queues, retrieval
from tessera.operators import sessions as chat
from tessera.plans._tables import Query, now, table, vectors


def chunk_documents(spark: SparkSession, sf: str):
    docs = table(spark, sf, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("doc"), "text")
    return chunking.chunk_documents(docs)


def markdown_table(spark, sf):
    rows = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda r: F.array(r["n_name"], r["n_nationkey"].cast("string"))).alias("t"))
    return rows.select("n_regionkey", text.markdown_table(F.col("t")).alias("markdown"))


def subquery_normalize(spark, sf):
    c = table(spark, sf, "conversations")
    rows = c.select((F.col("conv_id") * 100 + F.col("turn")).alias("query_id"), F.concat(F.lit(" "), F.col("text")).alias("query"), F.array(F.col("text"), F.lit(""), F.col("role"), F.lit("more"), F.lit("most")).alias("rewrites"))
    return retrieval.usable_subqueries(rows).select("query_id", F.array_join("subqueries", "|").alias("subqueries"))


def rerank(spark, sf):
    every = vectors(spark, sf)
    asked = every.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), "vector")
    near = retrieval.cosine_neighbours(every, asked, 6, drop_self=True)
    scores = near.where("query_id % 200 = 0 or rank <= 2").select("query_id", "chunk_id", ((F.col("chunk_id") * 7919) % 101 / 101.0).alias("rerank_score"))
    return retrieval.apply_rerank(near, scores, 4).select("query_id", "chunk_id", "rank", "degraded")


def product_lexical_search(spark, sf):
    products = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("category"), F.col("p_type").alias("text"))
    return retrieval.product_search(products, ["steel", "brand#12"], "small steel", 40).select("id", "strong", "overlap", "score")


def in_run_pairwise(spark, sf):
    every = vectors(spark, sf)
    return mining.drop_like_vectors(every.select(F.col("chunk_id").alias("ord"), "vector", F.col("label").cast("double").alias("quality")), 0.35)


def apply_mutations(spark, sf):
    o = table(spark, sf, "orders")
    facts = o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("fact_id"), F.col("o_orderpriority").alias("fact_key"), F.col("o_orderkey").cast("string").alias("content"), F.lit("active").alias("status"), F.lit(None).cast("long").alias("supersedes_id"))
    facts = facts.groupBy("user_id", "fact_key").agg(F.max_by(F.struct("fact_id", "content", "status", "supersedes_id"), "fact_id").alias("f")).select("user_id", "f.fact_id", "fact_key", "f.content", "f.status", "f.supersedes_id")
    changes = o.where("o_orderstatus <> 'F'").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderstatus") == "O", "set").otherwise("delete").alias("operation"), F.col("o_orderpriority").alias("fact_key"), F.col("o_orderkey").cast("string").alias("content"), F.col("o_orderkey").alias("new_id"))
    return memory.apply_mutations(facts, changes).groupBy("status").agg(F.count("*").alias("n"), F.count("supersedes_id").alias("links"))


def pre_dedup(spark, sf):
    every = vectors(spark, sf)
    asked = every.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), "vector")
    return retrieval.cosine_neighbours(every, asked, 1, drop_self=True).select("query_id", "chunk_id", (F.col("score") >= 0.4 - 1e-4).alias("duplicate"))


def index_verify(spark, sf):
    """Rows, distinct ids, and probes with a vector of the index that find it first."""
    every = vectors(spark, sf)
    asked = every.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), "vector")
    probes = retrieval.cosine_neighbours(every, asked, 1).agg(F.count_if(F.col("query_id") == F.col("chunk_id")).alias("found"), F.count("*").alias("probes"))
    return every.agg(F.count("*").alias("n"), F.countDistinct("chunk_id").alias("ids")).crossJoin(F.broadcast(probes))


def exclude_cases(spark, sf):
    drop = table(spark, sf, "labels").where("toxic = 1").select("doc_id").unionByName(table(spark, sf, "benchmark").select((F.col("item_id") + 10_000_000).alias("doc_id")))
    docs = table(spark, sf, "documents").select("doc_id")
    kept = docs.join(drop, "doc_id", "left_anti").agg(F.count("*").alias("n")).withColumn("kind", F.lit("kept"))
    return kept.unionByName(drop.join(docs, "doc_id", "left_anti").agg(F.count("*").alias("n")).withColumn("kind", F.lit("unknown")))


def _cases(spark, sf, passed, where="true"):
    """Labelled documents as cases: their languages are the categories, 'fr' under its other name."""
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").where(where)
    category = F.when(F.col("lang") == "en", "injection").when(F.col("lang") == "fr", "abuse").when(F.col("lang") == "de", "complaint").otherwise(F.col("lang"))
    critical = F.when(F.col("doc_id") % 5 == 0, F.col("doc_id") % 35 > 0)
    return rows.select(category.alias("category"), F.expr(passed).alias("passed"), critical.alias("critical"), (F.col("doc_id") % 50 == 7).alias("error"))


def ab_gates(spark, sf):
    """Quality before, harmless after, and both in the judged round."""
    found = evaluation.ab_gates(_cases(spark, sf, "quality = 1"), _cases(spark, sf, "toxic = 0"), _cases(spark, sf, "toxic = 0 OR quality = 1", "doc_id % 2 = 0"))
    figures = ["passed", "overall_ok", "categories_ok", "critical_ok", "api_errors_ok", "overall", "full", "critical_total", "critical_passed", "critical_rate", "api_errors"]
    rates = F.array_join(F.transform("rates", lambda r: F.concat_ws(":", r["category"], F.format_string("%.4f", r["was"]), F.format_string("%.4f", r["now"]))), ",")
    return found.select(*figures, F.array_join("failed_categories", ",").alias("failed_categories"), rates.alias("rates"))


def ab_relaxed_review(spark, sf):
    cases = table(spark, sf, "labels").select("doc_id", (F.col("quality") == 1).alias("passed"), (F.col("doc_id") % 9 == 0).alias("conflict"), (F.col("doc_id") % 4 == 0).alias("critical"), (F.col("toxic") == 1).alias("leak"))
    reason = F.when(F.col("conflict"), "excluded").when(~F.col("passed") & F.col("critical") & ~F.col("leak"), "flipped").otherwise("as_is")
    return cases.groupBy(reason.alias("review")).agg(F.count("*").alias("n"))


def dataset_checks(spark, sf):
    """Rows that break a rule, by rule."""
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    repeated = docs.groupBy("text").agg(F.count("*").alias("c")).where("c > 1").agg(F.count("*").alias("n")).withColumn("rule", F.lit("repeated_text"))
    orphans = labels.join(docs, "doc_id", "left_anti").agg(F.count("*").alias("n")).withColumn("rule", F.lit("label_without_document"))
    short = docs.where(F.length("text") < 100).agg(F.count("*").alias("n")).withColumn("rule", F.lit("short_text"))
    return repeated.unionByName(orphans).unionByName(short)


def holdout_assembly(spark, sf):
    labels = table(spark, sf, "labels")
    part = lambda where, kind: labels.where(where).select("doc_id", F.lit(kind).alias("kind"))
    every = part("quality = 1 and toxic = 0", "base").unionByName(part("quality = 0", "hard")).unionByName(part("quality = 1 and toxic = 1", "negative"))
    return every.withColumn("place", F.row_number().over(Window.partitionBy("kind").orderBy("doc_id")))


def _records(spark, sf):
    c = table(spark, sf, "conversations").where("role = 'assistant'")
    good = F.to_json(F.struct(F.col("text").alias("reply"), F.lit("faq").alias("intent"), (F.col("turn") / 10.0).alias("confidence")))
    return c.select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise(good).alias("raw"), "text")


def parse_final_json(spark, sf):
    rows = _records(spark, sf)
    parsed = F.from_json("raw", "reply string, intent string, confidence double")
    return rows.select("conv_id", "turn", F.coalesce(parsed["intent"], F.lit("none")).alias("intent"), F.round(parsed["confidence"], 6).alias("confidence"))


def fold_history(spark, sf):
    return _records(spark, sf).select("conv_id", "turn", chat.final_reply(F.col("raw")).alias("reply"))


def structured_outcome(spark, sf):
    k = F.from_json("props", "k long")["k"]
    return table(spark, sf, "events").groupBy("event_type").agg(F.sum(k).alias("total"), F.count(k).alias("known"))


def authz_subset_match(spark, sf):
    """Whether any call of a user has the wanted arguments among its own."""
    args = F.create_map(F.lit("type"), F.col("event_type"), F.lit("k"), F.get_json_object("props", "$.k"))
    wanted = F.create_map(F.lit("type"), F.lit("click"))
    inside = F.forall(F.map_entries(wanted), lambda e: F.element_at(args, e["key"]) == e["value"])
    return table(spark, sf, "events").groupBy("user_id").agg(F.bool_or(inside).alias("matched"))


def latency_probe(spark, sf):
    """The first 20 of each type, their linear 95th percentile, and the budget of five steps."""
    nth = F.row_number().over(Window.partitionBy("event_type").orderBy("event_id"))
    first = table(spark, sf, "events").withColumn("_n", nth).where("_n <= 20")
    p95 = evaluation.percentile_linear("value", 0.95)
    return first.groupBy("event_type").agg(F.round(p95, 9).alias("p95"), F.max("value").alias("slowest"), F.round(p95 * 5, 6).alias("budget"))


def eval_summary(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    return rows.agg(F.count("*").alias("cases"), F.count_if(F.col("quality") == 1).alias("passed"), F.round(F.avg("n_chars"), 6).alias("mean_chars"), F.max("n_chars").alias("longest"), F.countDistinct("lang").alias("languages"))


def tool_call_join(spark, sf):
    e = table(spark, sf, "events")
    calls = e.where("event_type = 'click'").select(F.col("user_id").alias("session"), F.lit(0).alias("turn"), (F.col("event_id") % 50).alias("call_id"), F.col("event_id").alias("name"))
    results = e.where("event_type <> 'click'").select(F.col("user_id").alias("session"), F.lit(0).alias("turn"), (F.col("event_id") % 50).alias("call_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("result"))
    return chat.join_tool_calls(calls, results).select("session", "call_id", "name", "result")


def rules_judge_join(spark, sf):
    rules = table(spark, sf, "documents").select("doc_id", (F.col("n_chars") > 1000).alias("rule_pass"))
    return rules.join(table(spark, sf, "labels"), "doc_id", "left").groupBy("rule_pass", F.coalesce((F.col("quality") / 5.0 * 5 >= 0.6).cast("string"), F.lit("unjudged")).alias("judge")).agg(F.count("*").alias("n"))


def join_candidates_conversations(spark, sf):
    joined = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.select(F.sha2(F.concat_ws("|", "c_mktsegment", "o_orderpriority"), 256).alias("fence")).where("fence is not null").dropDuplicates().orderBy("fence")


def anti_processed(spark, sf):
    done = table(spark, sf, "events").where("event_type = 'error' and ts >= timestamp_ntz'2024-01-28 00:00:00'").select("user_id").distinct()
    return table(spark, sf, "events").join(done, "user_id", "left_anti").groupBy("user_id").agg(F.count("*").alias("n"))


def oldest_first_revalidate(spark, sf):
    last = table(spark, sf, "customer").select("c_custkey").join(table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("seen")), "c_custkey", "left")
    done = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("c_custkey"))
    return last.join(done, "c_custkey", "left_anti").orderBy(F.asc_nulls_first("seen"), "c_custkey").limit(60).select("c_custkey")


def first_per_key(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.min_by("l_orderkey", F.struct("l_shipdate", "l_orderkey", "l_linenumber")).alias("first_order"))


def topk_stable(spark, sf):
    ranked = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("query_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), F.col("l_quantity").alias("score"))
    return retrieval.top_k(ranked, 3, [F.desc("score"), F.asc("ord")]).select("query_id", "ord", "rank")


def prune_turns(spark, sf):
    c = table(spark, sf, "conversations")
    done, waiting = c.where("turn = 2").select("conv_id").distinct(), c.where("turn = 6").select("conv_id").distinct()
    return c.join(done, "conv_id", "left_semi").join(waiting, "conv_id", "left_anti").where("turn < 3").select("conv_id", "turn")


def publish_batch_checks(spark, sf):
    o = table(spark, sf, "orders")
    newest = o.groupBy("o_custkey").agg(F.max("o_orderkey").alias("newest"))
    state = F.when(F.col("o_orderstatus") != "O", "status").when(F.col("o_orderkey") < F.col("newest"), "stale").when(F.col("o_totalprice") < 1000, "evidence").otherwise("ok")
    return o.join(newest, "o_custkey").groupBy(state.alias("finding")).agg(F.count("*").alias("n"))


def dead_letter_list(spark, sf):
    outcome = queues.settle(F.when(F.col("event_id") % 3 == 0, F.lit(500)).otherwise(F.lit(404)), (F.col("event_id") % 12).cast("int"))
    return table(spark, sf, "events").where(outcome == "dead").orderBy("event_id").limit(200).select("event_id", "user_id")


def tombstone_retention(spark, sf):
    return table(spark, sf, "events").where((F.col("event_type") == "signup") & (F.col("ts") <= now() - F.expr("INTERVAL 7 DAYS"))).groupBy("user_id").agg(F.count("*").alias("n"))


def conversation_fence_key(spark, sf):
    key = F.concat(F.lit("hk:"), F.substring(F.sha2(F.concat(F.lit('["conv",'), F.col("conv_id").cast("string"), F.lit("]")), 256), 1, 60))
    return table(spark, sf, "conversations").select("conv_id", key.alias("fence")).distinct()


def draft_expired(spark, sf):
    made = F.when(F.col("event_id") % 10 == 0, "not a time").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return table(spark, sf, "events").groupBy(claims.draft_expired(made, now(), 60 * 24 * 10).alias("expired")).agg(F.count("*").alias("n"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    chunk_documents, markdown_table, subquery_normalize, rerank, product_lexical_search, in_run_pairwise, apply_mutations, pre_dedup, index_verify, exclude_cases, ab_gates,
    ab_relaxed_review, dataset_checks, holdout_assembly, parse_final_json, fold_history, structured_outcome, authz_subset_match, latency_probe, eval_summary, tool_call_join,
    rules_judge_join, join_candidates_conversations, anti_processed, oldest_first_revalidate, first_per_key, topk_stable, prune_turns, publish_batch_checks, dead_letter_list,
    tombstone_retention, conversation_fence_key, draft_expired,
)}

_NEAR = """near AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 9) AS score FROM embeddings q, embeddings c WHERE q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM near)"""
_GRAMS = "list_distinct(list_transform(range(1, length({0})), lambda i: {0}[i:i + 1]))"

ORACLE_SQL: dict[str, str] = {
    "markdown_table": "SELECT n_regionkey, string_agg('| ' || n_name || ' | ' || n_nationkey || ' |' || CASE WHEN first THEN chr(10) || '| --- | --- |' ELSE '' END, chr(10) ORDER BY n_nationkey) AS markdown FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) = 1 AS first FROM nation) GROUP BY n_regionkey",
    "subquery_normalize": "WITH q AS (SELECT conv_id * 100 + turn AS query_id, trim(text) AS a, role FROM conversations) SELECT query_id, array_to_string(list_filter([a, CASE WHEN role <> a THEN role END, 'more'], lambda x: x <> ''), '|') AS subqueries FROM q",
    "rerank": f"""WITH {_NEAR}, six AS (SELECT *, CASE WHEN query_id % 200 = 0 OR r <= 2 THEN (chunk_id * 7919) % 101 / 101 END AS s FROM placed WHERE r <= 6), d AS (SELECT *, count(s) OVER (PARTITION BY query_id) < 4 AS degraded FROM six),
        n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN NOT degraded THEN s END DESC NULLS LAST, r)::INT AS rank FROM d WHERE degraded OR s IS NOT NULL) SELECT query_id, chunk_id, rank, degraded FROM n WHERE rank <= 4""",
    "product_lexical_search": f"""WITH g AS (SELECT p_partkey AS id, greatest(CASE WHEN lower(p_brand) = 'steel' THEN 4 WHEN contains(lower(p_name), 'steel') THEN 3 WHEN contains(lower(p_type), 'steel') THEN 2 ELSE 0 END,
            CASE WHEN lower(p_brand) = 'brand#12' THEN 4 WHEN contains(lower(p_name), 'brand#12') THEN 3 WHEN contains(lower(p_type), 'brand#12') THEN 2 ELSE 0 END) AS strong,
            len(list_intersect({_GRAMS.format("'small steel'")}, {_GRAMS.format("lower(p_name || ' ' || p_type)")}))::INT AS overlap, len(list_intersect({_GRAMS.format("'small steel'")}, {_GRAMS.format("lower(p_brand)")})) AS category FROM part)
        SELECT id, strong, overlap, (100 * strong + 10 * category + overlap)::INT AS score FROM g WHERE strong > 0 OR overlap >= 3 ORDER BY score DESC, id LIMIT 40""",
    "pre_dedup": f"WITH {_NEAR} SELECT query_id, chunk_id, score >= 0.4 - 1e-4 AS duplicate FROM placed WHERE r = 1",
    "index_verify": "SELECT count(*) AS n, count(DISTINCT vec_id) AS ids, count(*) FILTER (WHERE vec_id % 100 = 0) AS found, count(*) FILTER (WHERE vec_id % 100 = 0) AS probes FROM embeddings",
    "exclude_cases": "SELECT 'kept' AS kind, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) UNION ALL SELECT 'unknown', count(*) FROM benchmark",
    "ab_gates": """WITH l AS (SELECT doc_id, CASE lang WHEN 'en' THEN 'inject' WHEN 'fr' THEN 'abuse' WHEN 'de' THEN 'complaint' ELSE lang END AS c, quality = 1 AS was, toxic = 0 AS now, doc_id % 5 = 0 AS tested, doc_id % 35 > 0 AS held FROM labels JOIN documents USING (doc_id)),
        g AS (SELECT k.c, k.o, avg(was::INT) AS was, avg(now::INT) AS now FROM (SELECT unnest(['inject', 'abuse', 'complaint']) AS c, unnest([1, 2, 3]) AS o) k LEFT JOIN l USING (c) GROUP BY ALL), f AS (SELECT *, coalesce(now >= 0.7 AND now >= coalesce(was, 0), false) AS good FROM g),
        t AS (SELECT avg(now::INT) AS overall, avg((now OR was)::INT) FILTER (WHERE doc_id % 2 = 0) AS full_rate, count(*) FILTER (WHERE tested) AS critical_total, count(*) FILTER (WHERE tested AND held) AS critical_passed,
            count(*) FILTER (WHERE doc_id % 2 = 0 AND doc_id % 50 = 7) AS api_errors FROM l),
        o AS (SELECT overall >= 0.8 AND full_rate >= 0.8 AS overall_ok, (SELECT bool_and(good) FROM f) AS categories_ok, critical_total = critical_passed AS critical_ok, api_errors = 0 AS api_errors_ok, * FROM t)
        SELECT overall_ok AND categories_ok AND critical_ok AND api_errors_ok AS passed, overall_ok, categories_ok, critical_ok, api_errors_ok, round(overall, 4) AS overall, round(full_rate, 4) AS "full", critical_total, critical_passed,
            CASE WHEN critical_total > 0 THEN round(critical_passed / critical_total, 4) ELSE 1 END AS critical_rate, api_errors, (SELECT coalesce(string_agg(c, ',' ORDER BY o), '') FROM f WHERE NOT good) AS failed_categories,
            (SELECT string_agg(c || ':' || CASE WHEN was IS NULL THEN 'null' ELSE printf('%.4f', was) END || ':' || CASE WHEN now IS NULL THEN 'null' ELSE printf('%.4f', now) END, ',' ORDER BY o) FROM f) AS rates FROM o""",
    "ab_relaxed_review": "SELECT CASE WHEN doc_id % 9 = 0 THEN 'excluded' WHEN quality <> 1 AND doc_id % 4 = 0 AND toxic <> 1 THEN 'flipped' ELSE 'as_is' END AS review, count(*) AS n FROM labels GROUP BY 1",
    "dataset_checks": "SELECT 'repeated_text' AS rule, (SELECT count(*) FROM (SELECT text FROM documents GROUP BY text HAVING count(*) > 1)) AS n UNION ALL SELECT 'label_without_document', (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) UNION ALL SELECT 'short_text', (SELECT count(*) FROM documents WHERE length(text) < 100)",
    "holdout_assembly": "SELECT doc_id, kind, row_number() OVER (PARTITION BY kind ORDER BY doc_id)::INT AS place FROM (SELECT doc_id, CASE WHEN quality = 0 THEN 'hard' WHEN toxic = 0 THEN 'base' ELSE 'negative' END AS kind FROM labels)",
    "parse_final_json": "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'none' ELSE 'faq' END AS intent, CASE WHEN turn % 2 = 1 THEN round(turn / 10, 6) END AS confidence FROM conversations WHERE role = 'assistant'",
    "fold_history": "SELECT conv_id, turn, text AS reply FROM conversations WHERE role = 'assistant'",
    "structured_outcome": "SELECT event_type, sum((props->>'k')::BIGINT)::BIGINT AS total, count(props->>'k') AS known FROM events GROUP BY event_type",
    "authz_subset_match": "SELECT user_id, bool_or(event_type = 'click') AS matched FROM events GROUP BY user_id",
    "latency_probe": "SELECT event_type, round(quantile_cont(value, 0.95), 9) AS p95, max(value) AS slowest, round(quantile_cont(value, 0.95) * 5, 6) AS budget FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id) <= 20) GROUP BY event_type",
    "eval_summary": "SELECT count(*) AS cases, count(*) FILTER (WHERE quality = 1) AS passed, round(avg(n_chars), 6) AS mean_chars, max(n_chars) AS longest, count(DISTINCT lang) AS languages FROM labels JOIN documents USING (doc_id)",
    "tool_call_join": """WITH r AS (SELECT user_id, event_id % 50 AS call_id, arg_max(event_type, event_id) AS result FROM events WHERE event_type <> 'click' GROUP BY ALL)
        SELECT e.user_id AS session, e.event_id % 50 AS call_id, event_id AS name, result FROM events e LEFT JOIN r ON r.user_id = e.user_id AND r.call_id = e.event_id % 50 WHERE event_type = 'click'""",
    "rules_judge_join": "SELECT n_chars > 1000 AS rule_pass, coalesce((quality >= 0.6)::VARCHAR, 'unjudged') AS judge, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL",
    "join_candidates_conversations": "SELECT DISTINCT sha256(concat_ws('|', c_mktsegment, o_orderpriority)) AS fence FROM orders LEFT JOIN customer ON o_custkey = c_custkey ORDER BY fence",
    "anti_processed": "SELECT user_id, count(*) AS n FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-28') GROUP BY user_id",
    "oldest_first_revalidate": "SELECT c_custkey FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS seen FROM orders GROUP BY 1) ON o_custkey = c_custkey WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier) ORDER BY seen NULLS FIRST, c_custkey LIMIT 60",
    "first_per_key": "SELECT l_partkey, arg_min(l_orderkey, (l_shipdate, l_orderkey, l_linenumber)) AS first_order FROM lineitem GROUP BY l_partkey",
    "topk_stable": "SELECT l_suppkey AS query_id, l_orderkey * 10 + l_linenumber AS ord, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC, l_orderkey * 10 + l_linenumber)::INT AS rank FROM lineitem QUALIFY rank <= 3",
    "prune_turns": "SELECT conv_id, turn FROM conversations WHERE turn < 3 AND conv_id IN (SELECT conv_id FROM conversations WHERE turn = 2) AND conv_id NOT IN (SELECT conv_id FROM conversations WHERE turn = 6)",
    "publish_batch_checks": "SELECT CASE WHEN o_orderstatus <> 'O' THEN 'status' WHEN o_orderkey < newest THEN 'stale' WHEN o_totalprice < 1000 THEN 'evidence' ELSE 'ok' END AS finding, count(*) AS n FROM (SELECT *, max(o_orderkey) OVER (PARTITION BY o_custkey) AS newest FROM orders) GROUP BY 1",
    "dead_letter_list": "SELECT event_id, user_id FROM events WHERE NOT (event_id % 3 = 0 AND event_id % 12 < 8) ORDER BY event_id LIMIT 200",
    "tombstone_retention": "SELECT user_id, count(*) AS n FROM events WHERE event_type = 'signup' AND ts <= TIMESTAMP '2024-01-24 00:00:00' GROUP BY user_id",
    "conversation_fence_key": "SELECT DISTINCT conv_id, 'hk:' || sha256('[\"conv\",' || conv_id || ']')[1:60] AS fence FROM conversations",
    "draft_expired": "SELECT event_id % 10 = 0 OR date_trunc('second', ts) < TIMESTAMP '2024-01-31' - INTERVAL 10 DAYS AS expired, count(*) AS n FROM events GROUP BY 1",
}
