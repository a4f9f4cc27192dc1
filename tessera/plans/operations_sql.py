"""The SQL that checks the queries of ``operations``."""

from __future__ import annotations

_NOW = "TIMESTAMP '2024-01-31 00:00:00'"
_JOBS = """jobs AS (
    SELECT event_id AS job_id, ['queued', 'running', 'retry_wait', 'done', 'failed', 'blocked'][event_id % 6 + 1] AS status, event_type AS operation, ts AS created_at,
           ts + to_hours(event_id % 72) AS next_run_at, ts + to_hours(event_id % 48) AS lease_until, ts + to_hours(event_id % 24) AS finished_at, (event_id % 10)::INT AS attempts, user_id
    FROM events
)"""
_FACTS = """facts AS (
    SELECT conv_id AS user_id, conv_id * 100 + turn AS fact_id, text AS content, CASE role WHEN 'user' THEN 'preference' WHEN 'system' THEN 'identity' ELSE 'event' END AS category,
           CASE WHEN turn % 4 = 3 THEN 'superseded' ELSE 'active' END AS status, day AS created_at, day AS updated_at, CASE WHEN turn % 3 > 0 THEN day END AS valid_from,
           CASE WHEN turn % 4 = 3 THEN day + to_days(200) END AS invalid_at
    FROM (SELECT *, TIMESTAMP '2024-01-01' + to_days(((conv_id * 7 + turn * 31) % 900 - 600)::INT) AS day FROM conversations)
)"""
_GRAMS = "list_distinct(list_transform(regexp_extract_all({0}, '[0-9A-Za-z]+'), lambda x: lower(x)))"
_DICE = "CASE WHEN len({0}) = 0 OR len({1}) = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect({0}, {1})) / (len({0}) + len({1})) END"
_SCORED = f"""{_FACTS}, graded AS (
    SELECT *, {_DICE.format("['the', 'and', 'of']", _GRAMS.format('content'))} AS alike, CASE category WHEN 'identity' THEN 0.15::DOUBLE WHEN 'preference' THEN 0.1::DOUBLE ELSE 0 END AS weight,
           greatest(date_diff('second', created_at, {_NOW}) / 86400, 0) AS age FROM facts
), scored AS (SELECT *, 0.1::DOUBLE * exp(-age / 180) AS fresh FROM graded)"""
_TURNS = """turned AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS msg_index FROM conversations),
turns AS (
    SELECT conv_id AS session, msg_index, arg_max(text, turn) FILTER (WHERE role = 'user') AS question, arg_max(text, turn) FILTER (WHERE role = 'assistant') AS answer
    FROM turned WHERE msg_index >= 0 GROUP BY ALL HAVING count(*) FILTER (WHERE role = 'assistant') > 0
)"""
_HOURLY = "hourly AS (SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY ALL)"
_LABELLED = "labels JOIN documents USING (doc_id)"
_ALIKE = """pairs AS (
    SELECT x.vec_id AS a, y.vec_id AS b FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id
    WHERE round(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 9) >= 0.35 - 1e-4)"""
_BUCKETS = ("1.0", "5.0", "10.0", "25.0", "50.0", "100.0", "250.0")
_HISTOGRAM = "buckets AS (" + " UNION ALL ".join(f"SELECT event_type, {b}::DOUBLE AS le, count(*) FILTER (WHERE value <= {b}) AS n FROM events GROUP BY event_type" for b in _BUCKETS) + ")"
_SKIP = """CASE WHEN confidence < 0.8 THEN 'low_confidence' WHEN human THEN 'requires_human' WHEN sources = 0 THEN 'no_sources' WHEN length(question) < 4 OR length(answer) < 20 THEN 'short'
    WHEN regexp_matches(question || ' ' || answer, '[\\w.+-]+@[\\w-]+(\\.[\\w-]+)+') THEN 'sensitive' END"""

ORACLE_SQL: dict[str, str] = {
    "job_stats": f"WITH {_JOBS} SELECT status, operation, count(*) AS n, min(created_at) AS oldest FROM jobs GROUP BY ALL",
    "eval_job_stats": f"WITH {_JOBS} SELECT count(*) FILTER (WHERE status IN ('queued', 'retry_wait')) AS backlog, count(*) FILTER (WHERE status = 'blocked') AS blocked, date_sub('second', min(created_at) FILTER (WHERE status IN ('queued', 'retry_wait')), {_NOW}) AS oldest_seconds FROM jobs",
    "queue_claim": f"WITH {_JOBS} SELECT job_id, status FROM jobs WHERE status IN ('queued', 'retry_wait') AND next_run_at <= {_NOW} OR status = 'running' AND lease_until < {_NOW} ORDER BY next_run_at, job_id LIMIT 50",
    "backoff": f"WITH {_JOBS} SELECT attempts, count(*) AS n, least(300.0::DOUBLE, 2.0::DOUBLE * 2.0::DOUBLE ** attempts) AS seconds, CASE WHEN attempts BETWEEN 1 AND 4 THEN [60, 300, 900, 3600][attempts] END AS table_seconds FROM jobs GROUP BY attempts",
    "outbox_settle": f"""WITH {_JOBS}, c AS (SELECT attempts, CASE WHEN job_id % 5 = 0 THEN NULL ELSE [200, 429, 503, 404][job_id % 4 + 1] END AS code FROM jobs)
        SELECT CASE WHEN code BETWEEN 200 AND 299 THEN 'done' WHEN (code IS NULL OR code = 429 OR code >= 500) AND attempts < 8 THEN 'retry' ELSE 'dead' END AS outcome, count(*) AS n FROM c GROUP BY 1""",
    "job_fail_transition": f"""WITH {_JOBS}, r AS (SELECT attempts, ['lock_wait', 'post_commit', 'permanent', 'other'][job_id % 4 + 1] AS reason FROM jobs)
        SELECT CASE WHEN reason = 'lock_wait' THEN 'queued' WHEN reason = 'post_commit' THEN 'retry_wait' WHEN reason = 'permanent' OR attempts >= 8 THEN 'failed' ELSE 'retry_wait' END AS status,
               CASE WHEN reason = 'lock_wait' THEN greatest(attempts - 1, 0) ELSE attempts END AS attempts, count(*) AS n FROM r GROUP BY ALL""",
    "job_retention": f"WITH {_JOBS} SELECT status, count(*) AS n, max(job_id) AS last_id FROM jobs WHERE status = 'done' AND finished_at < {_NOW} - INTERVAL 5 DAYS OR status = 'failed' AND finished_at < {_NOW} - INTERVAL 10 DAYS GROUP BY status",
    "next_due_delay": f"WITH {_JOBS} SELECT coalesce(greatest(date_sub('second', TIMESTAMP '2024-01-01', min(next_run_at)), 0), 60) AS delay FROM jobs WHERE status = 'queued'",
    "outbox_counts": f"WITH {_JOBS} SELECT count(*) FILTER (WHERE status IN ('queued', 'running', 'retry_wait')) AS in_flight, date_sub('second', min(created_at) FILTER (WHERE status IN ('queued', 'running', 'retry_wait')), {_NOW}) AS lag_seconds FROM jobs",
    "paged_list": "SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 20",
    "latest_row": f"WITH {_JOBS} SELECT user_id, job_id, status FROM jobs QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, job_id DESC) = 1",
    "join_jobs_conversations": f"WITH {_JOBS} SELECT job_id, user_id, last_turn FROM jobs LEFT JOIN (SELECT conv_id, max(turn) AS last_turn FROM conversations GROUP BY conv_id) ON user_id = conv_id WHERE status = 'queued'",
    "anti_exists_retention": "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')",
    "semi_in_subquery": "SELECT o_custkey, count(*) AS older FROM orders o WHERE o_orderdate < (SELECT max(o_orderdate) FROM orders p WHERE p.o_custkey = o.o_custkey) GROUP BY o_custkey",
    "ingest_versioning": """WITH held AS (SELECT o_custkey AS key, max(o_orderkey) AS version, arg_max(o_orderpriority, o_orderkey) AS digest FROM orders WHERE o_orderstatus <> 'O' GROUP BY 1)
        SELECT CASE WHEN version IS NULL THEN 'create' WHEN o_orderkey < version THEN 'stale' WHEN o_orderkey > version THEN 'update' WHEN o_orderpriority = digest THEN 'duplicate' ELSE 'conflict' END AS verdict, count(*) AS n
        FROM orders LEFT JOIN held ON key = o_custkey GROUP BY 1""",
    "stale_verdict_join": f"""WITH {_JOBS} SELECT CASE WHEN c_custkey IS NULL OR c_custkey % 5 <> job_id % 5 OR s_suppkey IS NOT NULL THEN 'obsolete' ELSE 'ok' END AS verdict, count(*) AS n
        FROM jobs LEFT JOIN customer ON c_custkey = user_id LEFT JOIN supplier ON s_suppkey = user_id AND s_suppkey % 5 = job_id % 5 GROUP BY 1""",
    "delete_barrier_anti": f"""WITH {_JOBS}, flying AS (SELECT user_id, CASE WHEN job_id % 4 = 0 THEN '' ELSE 'u' || (job_id % 3) END AS u FROM jobs WHERE status = 'running')
        SELECT s_suppkey AS session_key, 'u' || (s_suppkey % 3) AS session_uuid FROM supplier WHERE NOT EXISTS (SELECT 1 FROM flying WHERE user_id = s_suppkey AND u IN ('', 'u' || (s_suppkey % 3)))""",
    "ab_paired_join": "SELECT CASE WHEN (quality = 1) = (toxic = 0) THEN 'same' WHEN toxic = 0 THEN 'fixed' ELSE 'broken' END AS change, count(*) AS n FROM labels GROUP BY 1",
    "ab_missing_cases": "SELECT lang, count(*) AS missing FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY lang",
    "category_pass_rate": f"SELECT lang, count(*) AS cases, round(avg(quality), 9) AS rate FROM {_LABELLED} GROUP BY lang",
    "security_regressions": f"SELECT source AS category, CASE WHEN source = 'src3' THEN 'missing' ELSE 'dropped' END AS finding FROM {_LABELLED} GROUP BY source HAVING source = 'src3' OR avg(1 - toxic) < avg(quality)",
    "judge_disagreement": "SELECT round(avg((quality <> 1 - toxic)::INT), 9) AS disagreement FROM labels",
    "case_pass": """WITH r AS (SELECT l_discount * 10 AS a, CASE WHEN l_tax > 0.02::DOUBLE THEN l_tax * 12.5::DOUBLE END AS b, l_returnflag = 'R' AS error, l_linestatus = 'F' AS critical, l_quantity > 10 AS ok FROM lineitem)
        SELECT CASE WHEN error THEN false WHEN critical AND NOT ok THEN false ELSE a >= 0.6::DOUBLE AND coalesce(b >= 0.6::DOUBLE, true) END AS passed, count(*) AS n FROM r GROUP BY 1""",
    "auc_pairwise": f"""WITH r AS (SELECT length(text) AS score, quality FROM {_LABELLED}) SELECT round(avg(CASE WHEN p.score > n.score THEN 1 WHEN p.score = n.score THEN 0.5::DOUBLE ELSE 0 END), 9) AS auc FROM r p, r n WHERE p.quality = 1 AND n.quality = 0""",
    "wald_ci": f"SELECT lang, n, round(p, 9) AS p, round(p - 1.96::DOUBLE * sqrt(p * (1 - p) / n), 9) AS low, round(p + 1.96::DOUBLE * sqrt(p * (1 - p) / n), 9) AS high FROM (SELECT lang, count(*) AS n, avg((quality = 1)::INT) AS p FROM {_LABELLED} GROUP BY lang)",
    "percentiles": """WITH l AS (SELECT event_type, list(value ORDER BY value) AS v, round(quantile_cont(value, 0.95), 9) AS p3, round(quantile_cont(value, 0.5), 9) AS median FROM events GROUP BY event_type)
        SELECT event_type, v[greatest(1, ceil(len(v) * 0.95::DOUBLE))::INT] AS p1, v[round_even((len(v) - 1) * 0.95::DOUBLE, 0)::INT + 1] AS p2, p3, v[greatest(1, floor(len(v) * 0.9::DOUBLE))::INT] AS p4, median FROM l""",
    "rejection_grid": """WITH r AS (SELECT l_returnflag = 'A' AS positive, l_quantity / 50 AS top1, CASE WHEN l_tax > 0.01::DOUBLE THEN l_discount END AS gap, l_tax * 10 AS coverage FROM lineitem),
        g AS (SELECT * FROM (SELECT unnest([0.0::DOUBLE, 0.2, 0.4]) AS t_top1), (SELECT unnest([0.0::DOUBLE, 0.05]) AS t_gap), (SELECT unnest([0.0::DOUBLE, 0.3]) AS t_coverage)),
        t AS (SELECT *, (coalesce(t_top1 > 0 AND top1 < t_top1, false) OR coalesce(t_gap > 0 AND gap < t_gap, false) OR coalesce(t_coverage > 0 AND coverage < t_coverage, false))::INT AS no FROM r, g),
        a AS (SELECT t_top1, t_gap, t_coverage, avg(no) FILTER (WHERE NOT positive) AS nr, avg(no) FILTER (WHERE positive) AS pr FROM t GROUP BY ALL)
        SELECT t_top1, t_gap, t_coverage, round(nr, 9) AS negative_rejected, round(pr, 9) AS positive_rejected, nr >= 0.9 AND pr <= 0.05 AS feasible FROM a""",
    "release_gates": """SELECT event_type, array_to_string(list_filter([CASE WHEN avg(value) < 50 THEN 'recall_low' END, CASE WHEN quantile_cont(value, 0.95) > 150 THEN 'p95_high' END, CASE WHEN count(*) FILTER (WHERE value < 0) > 0 THEN 'degraded' END], lambda x: x IS NOT NULL), ',') AS failed FROM events GROUP BY event_type""",
    "llm_usage_cost": """WITH p(model, pp, cp) AS (VALUES ('click', 0.5::DOUBLE, 1.5::DOUBLE), ('view', 0.25::DOUBLE, 1.0::DOUBLE))
        SELECT event_type AS model, count(*) AS calls, sum(event_id % 1000)::BIGINT AS prompt_tokens, sum(event_id % 300)::BIGINT AS completion_tokens, round(sum(((event_id % 1000) * pp + (event_id % 300) * cp) / 1000), 6) AS cost
        FROM events LEFT JOIN p ON model = event_type GROUP BY event_type""",
    "dataset_stats": "SELECT o_orderstatus, count(*) AS n, count(DISTINCT o_custkey) AS users, round(avg(o_totalprice), 4) AS mean_total FROM orders GROUP BY o_orderstatus",
    "dataset_quota": "WITH q AS (SELECT greatest(2, floor(count(*) * 0.02::DOUBLE)::INT + 1) AS quota FROM documents) SELECT source, count(*) AS n, quota FROM documents, q GROUP BY source, quota HAVING count(*) > quota",
    "online_quality": f"SELECT event_type, count(*) AS n, round(avg((value > 10)::INT), 9) AS resolved FROM events WHERE ts >= {_NOW} - INTERVAL 72 HOURS GROUP BY event_type",
    "turn_sessionize": f"WITH {_TURNS} SELECT conv_id AS session, turn AS seq, msg_index::BIGINT AS msg_index FROM turned WHERE msg_index >= 0",
    "last_final_answer": f"WITH {_TURNS} SELECT session, msg_index::BIGINT AS msg_index, question, answer FROM turns",
    "suffix_budget": r"""WITH c AS (SELECT conv_id, turn, greatest(coalesce(list_sum(list_transform(regexp_extract_all(text, '[\x00-\x7f]+'), lambda r: length(r) // 4)), 0) + length(text)
            - coalesce(list_sum(list_transform(regexp_extract_all(text, '[\x00-\x7f]+'), lambda r: length(r))), 0), CASE WHEN regexp_matches(text, '\S') THEN 1 ELSE 0 END) + 4 AS cost FROM conversations)
        SELECT conv_id AS session, turn AS seq FROM c QUALIFY sum(cost) OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 120 OR row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1""",
    "evidence_nearest_customer": """SELECT conv_id AS session, turn AS seq, previous_seq, next_seq FROM (SELECT conv_id, turn, role,
            max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_seq,
            min(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_seq FROM conversations) WHERE role <> 'user'""",
    "watermark_consume": "SELECT conv_id AS session, turn AS seq FROM conversations JOIN (SELECT conv_id, max(turn) // 3 AS mark, max(turn) - 1 AS through_seq FROM conversations GROUP BY conv_id) USING (conv_id) WHERE turn > mark AND turn <= through_seq",
    "mine_filter": f"""WITH {_TURNS}, r AS (SELECT *, CASE WHEN session % 5 = 0 THEN 0.5::DOUBLE ELSE 0.9::DOUBLE END AS confidence, session % 7 = 0 AS human, msg_index % 3 AS sources FROM turns)
        SELECT coalesce({_SKIP}, 'kept') AS reason, count(*) AS n FROM r GROUP BY 1""",
    "judge_gate": "SELECT CASE WHEN doc_id % 11 = 0 THEN 'pending' WHEN quality <> 1 THEN 'skip' WHEN (doc_id % 10) / 10 < 0.8::DOUBLE THEN 'skip' WHEN toxic <> 0 THEN 'pending' ELSE 'publish' END AS decision, count(*) AS n FROM labels GROUP BY 1",
    "human_score": """WITH s AS (SELECT *, 1 - (doc_id % 10) / 10 AS novelty, 0.6::DOUBLE * quality + 0.4::DOUBLE * (1 - (doc_id % 10) / 10) AS composite FROM labels)
        SELECT doc_id, round(novelty, 9) AS novelty, round(composite, 9) AS composite, CASE WHEN doc_id % 13 = 0 THEN 'conflict' WHEN doc_id % 5 = 0 AND toxic = 1 THEN 'update' WHEN doc_id % 5 = 0 OR doc_id % 7 = 0 THEN 'duplicate'
            WHEN quality = 1 AND composite >= 0.7::DOUBLE THEN 'new' ELSE 'reject' END AS decision FROM s""",
    "judge_topn": "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, length(o_orderpriority) DESC, o_orderkey LIMIT 50",
    "cap_publish": "SELECT CASE WHEN nth <= 5 THEN 'publish' ELSE 'capacity' END AS decision, count(*) AS n FROM (SELECT row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nth FROM orders) GROUP BY 1",
    "ledger_aging": """WITH l AS (SELECT CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'aging' ELSE 'done' END AS status, o_orderdate::DATE AS created FROM orders)
        SELECT status, CASE WHEN status = 'pending' AND date_diff('day', created, DATE '1998-01-01') >= 30 THEN 'aging' WHEN status = 'aging' THEN 'rejected' ELSE status END AS new_status, count(*) AS n FROM l GROUP BY ALL""",
    "stratified_sample": "SELECT doc_id, lang FROM documents QUALIFY lang = 'es' OR row_number() OVER (PARTITION BY lang ORDER BY sha256(doc_id::VARCHAR)) <= 3",
    "corpus_reference_check": "SELECT DISTINCT p_name[1:7] AS ref FROM part WHERE NOT EXISTS (SELECT 1 FROM nation WHERE starts_with(n_name, p_name[1:7]) OR starts_with(p_name[1:7], n_name))",
    "theta_self_join_pairs": f"WITH {_ALIKE} SELECT a, b FROM pairs",
    "dice_scores": f"""WITH g AS (SELECT conv_id, turn, {_GRAMS.format('text')} AS g FROM conversations), o AS (SELECT conv_id, g AS q FROM g WHERE turn = 0) SELECT conv_id, turn, round({_DICE.format('q', 'g')}, 9) AS dice FROM g JOIN o USING (conv_id) WHERE turn > 0""",
    "score_fact": f"WITH {_SCORED} SELECT fact_id, round(alike + weight + fresh, 9) AS score, round(CASE WHEN fact_id % 2 = 0 THEN 0.4::DOUBLE * alike + 0.3::DOUBLE ELSE alike END + weight + fresh, 9) AS fused FROM scored",
    "select_facts": f"""WITH {_SCORED}, kept AS (SELECT *, round(alike + weight + fresh, 9) AS score FROM scored WHERE status = 'active' AND (category IN ('identity', 'preference') OR age <= 365) AND (alike >= 0.02 OR category = 'identity'))
        SELECT user_id, fact_id, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, created_at DESC, content)::INT AS rank FROM kept QUALIFY rank <= 3""",
    "facts_active_at": f"WITH {_FACTS} SELECT category, count(*) AS n FROM facts WHERE coalesce(valid_from <= TIMESTAMP '2023-10-01', true) AND coalesce(TIMESTAMP '2023-10-01' < invalid_at, true) GROUP BY category",
    "prune_versions": f"WITH {_FACTS} SELECT status, count(*) AS n FROM facts WHERE status = 'active' OR updated_at >= {_NOW} - INTERVAL 90 DAYS GROUP BY status",
    "active_cap": f"WITH {_FACTS}, c AS (SELECT status, row_number() OVER (PARTITION BY user_id, status = 'active' ORDER BY updated_at DESC, fact_id DESC) AS nth FROM facts) SELECT CASE WHEN status = 'active' AND nth > 3 THEN 'deleted' ELSE status END AS status, count(*) AS n FROM c GROUP BY 1",
    "retention_keep_last_n": f"WITH {_FACTS} SELECT user_id, fact_id FROM facts QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY fact_id DESC) <= 2",
    "embedding_backfill": f"WITH {_FACTS} SELECT fact_id FROM facts WHERE status = 'active' AND NOT (fact_id % 3 = 0 AND fact_id % 2 = 0)",
    "duplicate_clusters": f"""WITH RECURSIVE {_ALIKE}, both_ways AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), reach AS (SELECT a AS node, a AS r FROM both_ways UNION SELECT node, b FROM reach JOIN both_ways ON a = r)
        SELECT cluster, count(*) AS n FROM (SELECT node, min(r) AS cluster FROM reach GROUP BY node) GROUP BY cluster""",
    "sliding_window_limit": "SELECT event_id, hits, hits <= 2 AS allowed FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3599999999 MICROSECONDS PRECEDING AND CURRENT ROW) AS hits FROM events)",
    "idle_session_gap": """WITH m AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 6 HOURS THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM m) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOURS AS "end", count(*) AS n FROM s GROUP BY user_id, k""",
    "promql_rate": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(count(*) / 3600, 9) AS rate, round(sum(value), 6) AS total FROM events GROUP BY ALL",
    "sliding_windows": "SELECT start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 2 HOURS, ts) - to_hours(0), time_bucket(INTERVAL 2 HOURS, ts) - to_hours(2), time_bucket(INTERVAL 2 HOURS, ts) - to_hours(4)]) AS start FROM events) GROUP BY ALL",
    "histogram_buckets": f"WITH {_HISTOGRAM} SELECT event_type, le, n FROM buckets",
    "promql_histogram_quantile": f"""WITH {_HISTOGRAM}, every AS (SELECT * FROM buckets UNION ALL SELECT event_type, 'inf'::DOUBLE, count(value) FROM events GROUP BY event_type),
        r AS (SELECT *, coalesce(lag(le) OVER w, 0) AS low, coalesce(lag(n) OVER w, 0) AS below, max(n) OVER (PARTITION BY event_type) * 0.9::DOUBLE AS want FROM every WINDOW w AS (PARTITION BY event_type ORDER BY le))
        SELECT event_type, round(CASE WHEN le = 'inf'::DOUBLE THEN low ELSE low + (le - low) * (want - below) / (n - below) END, 6) AS quantile FROM r WHERE n >= want QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY le) = 1""",
    "promql_topk_24h": "SELECT day, user_id, row_number() OVER (PARTITION BY day ORDER BY total DESC, user_id)::INT AS rank FROM (SELECT date_trunc('day', ts)::TIMESTAMP AS day, user_id, round(sum(value), 6) AS total FROM events GROUP BY ALL) QUALIFY rank <= 3",
    "promql_spike": f"WITH {_HOURLY}, t AS (SELECT *, avg(n) OVER (PARTITION BY event_type ORDER BY hour RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND INTERVAL 1 SECOND PRECEDING) AS mean_before FROM hourly) SELECT event_type, hour, n, round(mean_before, 9) AS mean_before FROM t WHERE n > 2 * mean_before",
    "alert_for": f"""WITH {_HOURLY}, a AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY hour) AS i FROM hourly), r AS (SELECT *, i - row_number() OVER (PARTITION BY event_type ORDER BY hour) AS run FROM a WHERE n >= 3)
        SELECT event_type, min(hour) AS start, max(hour) AS "end", count(*) AS n FROM r GROUP BY event_type, run HAVING count(*) >= 3""",
    "order_get": """WITH asked AS (SELECT CASE WHEN l_linenumber = 1 THEN -l_orderkey ELSE l_orderkey END AS id, l_suppkey AS u FROM lineitem),
        c AS (SELECT CASE WHEN o_orderkey IS NULL THEN 'NOT_FOUND' WHEN o_custkey <> u THEN 'ACCESS_DENIED' ELSE 'OK' END AS code, o_orderstatus FROM asked LEFT JOIN orders ON o_orderkey = id)
        SELECT code, CASE WHEN code = 'OK' THEN o_orderstatus END AS status, count(*) AS n FROM c GROUP BY ALL""",
    "order_list_limit": "SELECT o_custkey AS user_id, o_orderkey AS order_id, count(*) OVER (PARTITION BY o_custkey) AS total, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC)::INT AS nth FROM orders QUALIFY nth <= 3",
    "order_logistics_join": "SELECT o_orderkey, o_orderstatus, shipped, lines FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS shipped, count(*) AS lines FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey",
    "sla_breach": f"WITH {_JOBS} SELECT status, count(DISTINCT job_id) AS n FROM jobs WHERE CASE WHEN status = 'done' THEN finished_at ELSE {_NOW} END > created_at + INTERVAL 30 MINUTES GROUP BY status",
    "channel_poll": "SELECT event_id, event_type FROM events WHERE event_id > 500 ORDER BY event_id LIMIT 100",
    "union_routes": "SELECT 'customer' AS kind, count(*) AS n, max(c_custkey) AS last FROM customer UNION ALL SELECT 'supplier', count(*), max(s_suppkey) FROM supplier",
    "intersect_except": "SELECT 'with' AS kind, count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'without', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
}
