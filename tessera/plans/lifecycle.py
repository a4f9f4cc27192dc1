"""Queries of job, upload and document states, evidence rules and folds, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import lifecycle as lc
from tessera.operators import memory, retrieval
from tessera.plans._tables import Query, messages, now, table, vectors

_STATES = ("uploading", "queued", "validating", "indexing", "indexed", "delete_queued", "deleting", "failed", "cancelled", "deleted")


def _state(c, shift=0):
    return F.element_at(F.array(*map(F.lit, _STATES)), ((c + shift) % 10 + 1).cast("int"))


def doc_state_transition(spark, sf):
    e = table(spark, sf, "events").select(_state(F.col("event_id")).alias("before"), _state(F.floor(F.col("event_id") / 10)).alias("after"))
    return e.withColumn("allowed", lc.transition_allowed(F.col("before"), F.col("after"))).groupBy("before", "after", "allowed").agg(F.count("*").alias("n"))


def _jobs(spark, sf):
    states = F.element_at(F.array(*map(F.lit, ("queued", "retry_wait", "failed", "blocked", "done", "dead_letter"))), (F.col("event_id") % 6 + 1).cast("int"))
    return table(spark, sf, "events").select("event_id", states.alias("status"), _state(F.col("user_id")).alias("doc_status"), (F.col("event_id") % 9).cast("int").alias("attempts"), (F.col("event_id") % 4 > 0).alias("retryable"), "ts")


def job_cancel(spark, sf):
    return lc.cancel(_jobs(spark, sf)).groupBy("status", "doc_status", "new_status").agg(F.count("*").alias("n"))


def job_retry(spark, sf):
    return lc.retry(_jobs(spark, sf)).groupBy("status", "new_status").agg(F.count("*").alias("n"), F.sum("new_attempts").alias("attempts"))


def dead_letter_replay(spark, sf):
    return lc.replay(_jobs(spark, sf)).groupBy("status", "new_status").agg(F.count("*").alias("n"), F.sum("new_attempts").alias("attempts"))


def _uploads(spark, sf):
    return table(spark, sf, "events").select(F.col("event_id").alias("doc_id"), _state(F.col("event_id")).alias("status"), F.col("ts").alias("changed_at"), (F.col("ts") + F.expr("INTERVAL 5 DAYS")).alias("expires_at"))


def orphan_expiry(spark, sf):
    return lc.expire_orphans(_uploads(spark, sf), now()).groupBy("status", "new_status").agg(F.count("*").alias("n"))


def upload_gc(spark, sf):
    return lc.collectable(_uploads(spark, sf), now(), {"deleted": "7 DAYS", "failed": "14 DAYS", "cancelled": "1 MINUTE"}, 100).select("doc_id", "status")


def refund_app_lookup(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("user_id"))
    lines = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("application_id"), F.col("l_orderkey").alias("order_id")).distinct()
    applications = lines.join(orders, "order_id")
    by_app, by_order = F.col("l_linenumber") % 2 == 0, F.col("l_linenumber") % 3 == 0
    asked = table(spark, sf, "lineitem").join(orders, F.col("l_orderkey") == F.col("order_id")).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ask_id"), (F.col("user_id") + F.when(F.col("l_linenumber") == 4, 1).otherwise(0)).alias("user_id"),
        F.when(by_app, F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("application_id"), F.when(by_order, F.col("l_orderkey")).alias("order_id"),
    )
    return lc.refund_lookup(asked, applications, orders).groupBy("code").agg(F.count("*").alias("n"), F.sum("n").alias("found"))


def parent_or_self(spark, sf):
    c = table(spark, sf, "conversations")
    parents = c.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda r: r["text"]), "\n").alias("parent"))
    body = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("| head |\n"), F.col("text"))).when(F.col("turn") % 3 == 1, F.concat(F.lit("other "), F.col("text"))).otherwise(F.col("text"))
    found = c.join(parents, "conv_id").withColumn("body", body)
    return found.select("conv_id", "turn", (lc.parent_or_self(F.col("body"), F.col("parent"), F.lit("| head |\n")) == F.col("parent")).alias("whole"))


def _near(spark, sf, k):
    every = vectors(spark, sf)
    asked = every.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), "vector")
    return retrieval.cosine_neighbours(every, asked, k, drop_self=True)


def evidence_diagnostics(spark, sf):
    items = _near(spark, sf, 6).select("query_id", "rank", F.round("score", 6).alias("score"), (F.col("chunk_id") % 3).alias("source"), (F.col("chunk_id") % 4 == 0).alias("tainted"))
    return lc.evidence_diagnostics(items).select("query_id", "n_items", "tainted", "top1", F.round("gap", 6).alias("gap"), F.array_join(F.col("sources").cast("array<string>"), ",").alias("sources"))


def query_rewrite_guard(spark, sf):
    c = table(spark, sf, "conversations")
    answer = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("\n \n  \""), F.col("text"), F.lit(" again\" \nmore"))).when(F.col("turn") % 3 == 1, F.col("text"))
    answer = F.when(F.col("turn") == 2, F.concat(F.lit("Rewrite ： \""), F.left("text", F.lit(9)), F.lit("\""))).when(F.col("turn") == 5, F.concat(F.lit("作为AI，"), "role")).otherwise(answer)
    return c.select("conv_id", "turn", lc.rewritten_query(F.col("role"), answer).alias("query"))


def rerank_response_parse(spark, sf):
    e = table(spark, sf, "events")
    id_, value = F.col("event_id").cast("string"), (F.col("event_id") % 7).cast("string")
    answer = (
        F.when(F.col("event_id") % 4 == 0, F.concat(F.lit('{"results": [{"index": '), id_, F.lit(', "relevance_score": '), value, F.lit('.5}, {"index": 1}, 7]}')))
        .when(F.col("event_id") % 4 == 1, F.concat(F.lit("[["), id_, F.lit(", "), value, F.lit("], [3]]"))).when(F.col("event_id") % 4 == 2, F.concat(F.lit('[{"index": '), id_, F.lit(', "score": 1}]'))).otherwise("no json")
    )
    return lc.rerank_scores(e.select(F.col("event_id").alias("query_id"), answer.alias("answer")))


def final_multi_search(spark, sf):
    near = _near(spark, sf, 8).select((F.col("query_id") % 3).alias("question"), F.col("query_id").alias("query"), "chunk_id", F.concat(F.lit("p"), (F.col("chunk_id") % 40).cast("string")).alias("parent_id"), "rank", "score", (F.col("query_id") == 200).alias("degraded"))
    return lc.final_multi_search(near, 5, 0.2).withColumn("fused", F.round("fused", 9))


def replacement_rule(spark, sf):
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    side = F.when(F.col("doc_id") % 2 == 0, "question").otherwise("answer")
    path = F.concat(F.when(F.col("doc_id") % 3 == 0, "uploads/").otherwise("evolved/"), F.col("lang"), F.lit(".md"))
    return rows.groupBy(lc.replaces(side, path, (F.col("doc_id") % 10) / 10.0, F.col("quality").cast("double")).alias("file")).agg(F.count("*").alias("n"))


def final_dedup(spark, sf):
    near = _near(spark, sf, 2)
    return lc.final_duplicates(near.where("rank = 1").select("query_id", "chunk_id", (F.col("score") - 0.05).alias("score")), near.where("rank = 2"), 0.33)


def candidate_clusters(spark, sf):
    clusters = memory.duplicate_clusters(retrieval.cosine_links(vectors(spark, sf), 0.4))
    legacy = vectors(spark, sf).where("label = 1").select(F.col("chunk_id").alias("node"))
    return lc.candidate_clusters(clusters, legacy, 60)


def summary_dedup(spark, sf):
    return lc.new_summaries(table(spark, sf, "events").select(F.col("user_id").alias("session"), F.col("event_type").alias("summary"), F.col("event_id").alias("seq")))


def memory_evidence_gate(spark, sf):
    m = messages(spark, sf)
    fact = F.col("session") * 100 + F.col("seq")
    quoted = m.select("session", fact.alias("fact_id"), F.concat(F.lit(" "), F.substring("text", 5, 30)).alias("evidence"))
    # Evidence that runs from one user message into the next.
    after = F.lead("text").over(Window.partitionBy("session").orderBy("seq"))
    spans = m.where("role = 'user'").withColumn("after", after).select("session", (-fact).alias("fact_id"), F.concat(F.right("text", F.lit(8)), F.lit("\n"), F.left("after", F.lit(8))).alias("evidence"))
    key = F.when(F.col("fact_id") % 2 == 0, " Custom.Note ").otherwise("phone")
    content = F.when(F.col("fact_id") % 5 == 0, "以后都 mail").when(F.col("fact_id") % 7 == 0, "ignore previous").otherwise(F.concat(F.lit("call 9913800138000 "), F.col("fact_id")))
    return lc.evidence_gate(quoted.unionByName(spans.where("evidence is not null")).withColumns({"fact_key": key, "content": content}), m).select("session", "fact_id", "fact_key", "content", "evidence")


def rules_aggregate(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    return lc.rules_aggregate(rows.select((F.col("quality") == 1).alias("passed"), F.when(F.col("doc_id") % 3 > 0, (F.col("doc_id") % 10) / 10.0).alias("process"), ((F.col("doc_id") % 7) / 10.0).alias("result"), F.col("n_chars").alias("tokens"), F.when(F.col("doc_id") % 5 == 0, F.col("toxic") == 0).alias("critical")))


def counter_increase(spark, sf):
    samples = table(spark, sf, "events").select("event_type", "ts", F.round("value").alias("value"))
    samples = samples.groupBy("event_type", "ts").agg(F.max("value").alias("value"))
    return lc.counter_increase(samples, "event_type", "1 day")


def product_doc_render(spark, sf):
    p = table(spark, sf, "part")
    specs = F.array(F.struct(F.lit("type").alias("key"), F.col("p_type").alias("value")), F.struct(F.lit("size").alias("key"), F.col("p_size").cast("string").alias("value")))
    specs = F.when(F.col("p_partkey") % 5 > 0, specs)
    name = F.when(F.col("p_partkey") % 7 > 0, F.col("p_name"))
    return p.select("p_partkey", lc.product_doc(F.col("p_partkey").cast("string"), name, F.col("p_type"), F.col("p_size").cast("double") + 0.25, F.col("p_size") % 3, F.col("p_brand"), specs).alias("doc"))


def product_namespace_check(spark, sf):
    p = table(spark, sf, "part")
    authority = F.when(F.col("p_size") % 2 == 0, " Product ").otherwise("policy")
    path = F.concat(F.when(F.col("p_partkey") % 3 == 0, "dir\\").otherwise(""), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 5 == 0, ".txt").otherwise(".md"))
    return p.groupBy(lc.in_product_namespace(authority, path).alias("inside")).agg(F.count("*").alias("n"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    doc_state_transition, job_cancel, job_retry, dead_letter_replay, orphan_expiry, upload_gc, refund_app_lookup, parent_or_self, evidence_diagnostics, query_rewrite_guard,
    rerank_response_parse, final_multi_search, replacement_rule, final_dedup, candidate_clusters, summary_dedup, memory_evidence_gate, rules_aggregate, counter_increase,
    product_doc_render, product_namespace_check,
)}

_NAMES = "['" + "', '".join(_STATES) + "']"
_STATE = f"{_NAMES}[({{0}} % 10 + 1)::INT]"
_ALLOWED = " OR ".join(f"(before = '{a}' AND after IN ({', '.join(repr(x) for x in b)}))" for a, b in lc.TRANSITIONS.items())
_JOBS = f"jobs AS (SELECT event_id, ['queued', 'retry_wait', 'failed', 'blocked', 'done', 'dead_letter'][(event_id % 6 + 1)::INT] AS status, {_STATE.format('user_id')} AS doc_status, (event_id % 9)::INT AS attempts, event_id % 4 > 0 AS retryable FROM events)"
_UPLOADS = f"uploads AS (SELECT event_id AS doc_id, {_STATE.format('event_id')} AS status, ts AS changed_at, ts + INTERVAL 5 DAYS AS expires_at FROM events)"
_NOW = "TIMESTAMP '2024-01-31'"
_PLACED = """placed AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 9) AS score,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 9) DESC, c.vec_id) AS r FROM embeddings q, embeddings c WHERE q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)"""

ORACLE_SQL: dict[str, str] = {
    "doc_state_transition": f"WITH e AS (SELECT {_STATE.format('event_id')} AS before, {_STATE.format('(event_id // 10)')} AS after FROM events) SELECT before, after, {_ALLOWED} AS allowed, count(*) AS n FROM e GROUP BY ALL",
    "job_cancel": f"WITH {_JOBS} SELECT status, doc_status, CASE WHEN status IN ('queued', 'retry_wait') AND doc_status IN ('queued', 'uploading', 'validating') THEN 'cancelled' ELSE status END AS new_status, count(*) AS n FROM jobs GROUP BY ALL",
    "job_retry": f"WITH {_JOBS}, r AS (SELECT *, status IN ('failed', 'blocked') AND retryable AS again FROM jobs) SELECT status, CASE WHEN again THEN 'queued' ELSE status END AS new_status, count(*) AS n, sum(CASE WHEN again THEN 0 ELSE attempts END)::BIGINT AS attempts FROM r GROUP BY ALL",
    "dead_letter_replay": f"WITH {_JOBS} SELECT status, CASE WHEN status = 'dead_letter' THEN 'pending' ELSE status END AS new_status, count(*) AS n, sum(CASE WHEN status = 'dead_letter' THEN 0 ELSE attempts END)::BIGINT AS attempts FROM jobs GROUP BY ALL",
    "orphan_expiry": f"WITH {_UPLOADS} SELECT status, CASE WHEN status = 'uploading' AND expires_at < {_NOW} THEN 'cancelled' ELSE status END AS new_status, count(*) AS n FROM uploads GROUP BY ALL",
    "upload_gc": f"WITH {_UPLOADS} SELECT doc_id, status FROM uploads WHERE (status = 'deleted' AND changed_at < {_NOW} - INTERVAL 7 DAYS) OR (status = 'failed' AND changed_at < {_NOW} - INTERVAL 14 DAYS) OR (status = 'cancelled' AND changed_at < {_NOW} - INTERVAL 1 MINUTE) ORDER BY changed_at, doc_id LIMIT 100",
    "refund_app_lookup": """WITH apps AS (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS application_id, l_orderkey AS order_id, o_custkey AS user_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'),
        asked AS (SELECT o_custkey + CASE WHEN l_linenumber = 4 THEN 1 ELSE 0 END AS user_id, CASE WHEN l_linenumber % 2 = 0 THEN l_orderkey * 10 + l_linenumber END AS a, CASE WHEN l_linenumber % 3 = 0 THEN l_orderkey END AS o FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
        answered AS (SELECT CASE WHEN (a IS NULL) = (o IS NULL) THEN 'invalid' WHEN a IS NOT NULL AND EXISTS (SELECT 1 FROM apps WHERE application_id = a AND apps.user_id = asked.user_id) THEN 'ok'
            WHEN o IS NOT NULL AND EXISTS (SELECT 1 FROM orders WHERE o_orderkey = o AND o_custkey = asked.user_id) THEN 'ok' ELSE 'not_found' END AS code, a, coalesce(p.n, 0) AS n FROM asked LEFT JOIN (SELECT order_id, count(*) AS n FROM apps GROUP BY 1) p ON p.order_id = o)
        SELECT code, count(*) AS n, sum(CASE WHEN code <> 'ok' THEN 0 WHEN a IS NOT NULL THEN 1 ELSE n END)::BIGINT AS found FROM answered GROUP BY code""",
    "parent_or_self": "WITH p AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS parent FROM conversations GROUP BY 1) SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN contains(parent, 'other ' || text) ELSE true END OR parent = text AS whole FROM conversations JOIN p USING (conv_id)",
    "evidence_diagnostics": f"""WITH {_PLACED}, items AS (SELECT query_id, r, round(score, 6) AS score, chunk_id % 3 AS source, chunk_id % 4 = 0 AS tainted FROM placed WHERE r <= 6),
        clean AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, r) AS nth FROM items WHERE NOT tainted), s AS (SELECT query_id, string_agg(source, ',' ORDER BY r) AS sources FROM (SELECT query_id, source, min(r) AS r FROM clean GROUP BY ALL) GROUP BY 1),
        f AS (SELECT query_id, count(*) AS n_items, max(score) FILTER (WHERE nth = 1) AS top1, round(max(score) FILTER (WHERE nth = 1) - max(score) FILTER (WHERE nth = 2), 6) AS gap FROM clean GROUP BY 1)
        SELECT i.query_id, coalesce(n_items, 0) AS n_items, i.tainted, top1, gap, sources FROM (SELECT query_id, count(*) FILTER (WHERE tainted) AS tainted FROM items GROUP BY 1) i LEFT JOIN f USING (query_id) LEFT JOIN s USING (query_id)""",
    "query_rewrite_guard": """WITH a AS (SELECT conv_id, turn, role, CASE WHEN turn = 2 THEN trim(split_part(left(text, 9), chr(10), 1)) WHEN turn = 5 THEN '' WHEN turn % 3 = 0 THEN trim(split_part(text || ' again', chr(10), 1)) WHEN turn % 3 = 1 THEN trim(split_part(text, chr(10), 1)) ELSE '' END AS line FROM conversations)
        SELECT conv_id, turn, CASE WHEN line <> '' AND line <> role AND length(line) <= least(200, greatest(64, 4 * length(role))) THEN line ELSE role END AS query FROM a""",
    "rerank_response_parse": "SELECT event_id AS query_id, event_id::INT AS place, CASE event_id % 4 WHEN 0 THEN event_id % 7 + 0.5::DOUBLE WHEN 1 THEN (event_id % 7)::DOUBLE ELSE 1::DOUBLE END AS score FROM events WHERE event_id % 4 < 3",
    "final_multi_search": f"""WITH {_PLACED}, h AS (SELECT query_id % 3 AS question, query_id AS query, chunk_id, chunk_id % 40 AS g, r, score, query_id = 200 AS degraded FROM placed WHERE r <= 8), gated AS (SELECT * FROM h WHERE score >= 0.2),
        fused AS (SELECT question, g, chunk_id, round(sum(1 / (60.0::DOUBLE + r)), 12) AS fused FROM gated GROUP BY ALL), first AS (SELECT *, row_number() OVER (PARTITION BY question, g ORDER BY fused DESC, chunk_id) AS nth FROM fused),
        best AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY fused DESC, chunk_id)::INT AS rank FROM first WHERE nth = 1)
        SELECT question, chunk_id, rank, round(fused, 9) AS fused, queries, degraded FROM best JOIN (SELECT question, g, string_agg(query, ',' ORDER BY query) AS queries FROM (SELECT DISTINCT question, g, query::VARCHAR AS query FROM gated) GROUP BY ALL) USING (question, g)
        JOIN (SELECT question, bool_or(degraded) AS degraded FROM h GROUP BY 1) USING (question) WHERE rank <= 5""",
    "replacement_rule": "SELECT CASE WHEN doc_id % 2 = 0 AND doc_id % 3 > 0 AND doc_id % 10 / 10 >= coalesce(quality, -1) THEN lang || '.md' END AS file, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1",
    "final_dedup": f"""WITH {_PLACED}, b AS (SELECT query_id, 'question' AS side, chunk_id, 0 AS o FROM placed WHERE r = 1 AND score - 0.05 >= 0.33 - 1e-4 UNION ALL SELECT query_id, 'answer', chunk_id, 1 FROM placed WHERE r = 2 AND score >= 0.33 - 1e-4)
        SELECT query_id, side, chunk_id FROM b QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY o) = 1""",
    "candidate_clusters": """WITH RECURSIVE pairs AS (SELECT x.vec_id AS a, y.vec_id AS b FROM embeddings x JOIN embeddings y ON x.vec_id <> y.vec_id WHERE round(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 9) >= 0.4 - 1e-4),
        reach AS (SELECT a AS node, a AS r FROM pairs UNION SELECT node, b FROM reach JOIN pairs ON a = r), c AS (SELECT node, min(r) AS cluster FROM reach GROUP BY node),
        every AS (SELECT cluster, count(*) AS size FROM c GROUP BY 1 UNION ALL SELECT vec_id, 1 FROM embeddings WHERE label = 1 AND vec_id NOT IN (SELECT node FROM c))
        SELECT cluster, size, row_number() OVER (ORDER BY size > 1, size DESC, cluster)::INT AS place FROM every QUALIFY place <= 60""",
    "summary_dedup": "SELECT user_id AS session, event_type AS summary, min(event_id) AS seq FROM events GROUP BY ALL",
    "memory_evidence_gate": r"""WITH u AS (SELECT conv_id, string_agg(coalesce(text, ''), chr(10) ORDER BY turn) AS said FROM conversations WHERE role = 'user' GROUP BY 1),
        raw AS (SELECT conv_id, conv_id * 100 + turn AS fact_id, text[5:34] AS e FROM conversations
            UNION ALL SELECT conv_id, -(conv_id * 100 + turn), right(text, 8) || chr(10) || left(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), 8) FROM conversations WHERE role = 'user'),
        m AS (SELECT conv_id, fact_id, regexp_replace(e, '^\s+|\s+$', '', 'g') AS e, fact_id % 2 = 0 AS free FROM raw WHERE e IS NOT NULL)
        SELECT conv_id AS session, fact_id, CASE WHEN free THEN 'custom.note' ELSE 'phone' END AS fact_key, CASE WHEN fact_id % 5 = 0 THEN '以后都 mail' ELSE 'call 99[已脱敏号码] ' || fact_id END AS content,
            regexp_replace(e, '1[3-9][0-9]{9}', '[已脱敏号码]', 'g') AS evidence FROM m LEFT JOIN u USING (conv_id)
        WHERE (coalesce(said, '') = '' OR (e <> '' AND contains(said, e))) AND NOT (fact_id % 5 = 0 AND free) AND NOT (fact_id % 5 <> 0 AND fact_id % 7 = 0)""",
    "rules_aggregate": """SELECT count(*) AS total, count(*) FILTER (WHERE quality = 1) AS passed, round(count(*) FILTER (WHERE quality = 1) / count(*), 4) AS pass_rate, round(avg(CASE WHEN doc_id % 3 > 0 THEN doc_id % 10 / 10 END), 4) AS process,
        round(avg(doc_id % 7 / 10), 4) AS result, sum(n_chars)::BIGINT AS tokens, count(*) FILTER (WHERE doc_id % 5 = 0) AS critical_total, count(*) FILTER (WHERE doc_id % 5 = 0 AND toxic = 0) AS critical_passed FROM labels JOIN documents USING (doc_id)""",
    "counter_increase": """WITH s AS (SELECT event_type, ts, max(round(value)) AS value FROM events GROUP BY ALL), b AS (SELECT *, lag(value) OVER (PARTITION BY event_type ORDER BY ts) AS was FROM s)
        SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS start, sum(CASE WHEN was IS NULL THEN 0 WHEN value >= was THEN value - was ELSE value END) AS increase FROM b GROUP BY ALL""",
    "product_doc_render": """SELECT p_partkey, array_to_string(list_filter(['---', 'status: active', 'authority: product', 'namespace: product', 'product_id: ' || p_partkey, 'category: ' || p_type, 'price: ' || p_size || '.25', 'effective_date: 2024-06-01', '---', '',
        '# ' || CASE WHEN p_partkey % 7 > 0 THEN p_name ELSE p_partkey::VARCHAR END, '', '## 商品信息', '- 商品编号：' || p_partkey, '- 类目：' || p_type, '- 价格：¥' || p_size || '.25', '- 库存：' || p_size % 3 || ' 件（' || CASE WHEN p_size % 3 > 0 THEN '有货' ELSE '缺货' END || '）', '',
        '## 商品卖点', p_brand, '', '## 规格参数', '| 参数 | 值 |', '| --- | --- |', CASE WHEN p_partkey % 5 > 0 THEN '| type | ' || p_type || ' |' END, CASE WHEN p_partkey % 5 > 0 THEN '| size | ' || p_size || ' |' END,
        '', '## 售后与配送', '支持七天无理由退换（以平台售后政策为准）；下单后 48 小时内发货。', ''], lambda x: x IS NOT NULL), chr(10)) AS doc FROM part""",
    "product_namespace_check": "SELECT p_size % 2 = 0 AND p_partkey % 3 > 0 AND p_partkey % 5 > 0 AS inside, count(*) AS n FROM part GROUP BY 1",
}
