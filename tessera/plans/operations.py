"""Queries over relational tables, events and conversations: joins, queues, windows, memory, mining and commerce."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import dice
from tessera.operators import commerce, evaluation, memory, mining, queues, retrieval
from tessera.operators import sessions as chat
from tessera.plans._tables import Query, messages, now, table, vectors
from tessera.streaming import windows


def _jobs(spark: SparkSession, sf: str) -> DataFrame:
    """Events as jobs: the type names the state."""
    e = table(spark, sf, "events")
    states = F.element_at(F.array(*map(F.lit, ("queued", "running", "retry_wait", "done", "failed", "blocked"))), (F.col("event_id") % 6 + 1).cast("int"))
    hours = lambda n: F.expr(f"make_interval(0, 0, 0, 0, cast({n} as int))")
    return e.select(
        F.col("event_id").alias("job_id"), states.alias("status"), F.col("event_type").alias("operation"), F.col("ts").alias("created_at"), (F.col("ts") + hours("event_id % 72")).alias("next_run_at"),
        (F.col("ts") + hours("event_id % 48")).alias("lease_until"), (F.col("ts") + hours("event_id % 24")).alias("finished_at"), (F.col("event_id") % 10).cast("int").alias("attempts"), "user_id",
    )


def _facts(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as facts: a conversation is a user, its roles are categories."""
    c = table(spark, sf, "conversations")
    day = F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, cast((conv_id * 7 + turn * 31) % 900 - 600 as int))")
    return c.select(
        F.col("conv_id").alias("user_id"), (F.col("conv_id") * 100 + F.col("turn")).alias("fact_id"), F.col("text").alias("content"),
        F.when(F.col("role") == "user", "preference").when(F.col("role") == "system", "identity").otherwise("event").alias("category"),
        F.when(F.col("turn") % 4 == 3, "superseded").otherwise("active").alias("status"), day.alias("created_at"), day.alias("updated_at"),
        F.when(F.col("turn") % 3 > 0, day).alias("valid_from"), F.when(F.col("turn") % 4 == 3, day + F.expr("interval 200 days")).alias("invalid_at"),
    )


def job_stats(spark, sf):
    return queues.job_stats(_jobs(spark, sf), ["status", "operation"], "created_at")


def eval_job_stats(spark, sf):
    return queues.queue_health(_jobs(spark, sf), now(), ["queued", "retry_wait"])


def queue_claim(spark, sf):
    return queues.claimable(_jobs(spark, sf), now(), 50).select("job_id", "status")


def backoff(spark, sf):
    return _jobs(spark, sf).groupBy("attempts").agg(F.count("*").alias("n")).select("attempts", "n", queues.backoff_seconds(F.col("attempts")).alias("seconds"), queues.backoff_table(F.col("attempts")).alias("table_seconds"))


def outbox_settle(spark, sf):
    code = F.when(F.col("job_id") % 5 == 0, F.lit(None)).otherwise(F.element_at(F.array(*map(F.lit, (200, 429, 503, 404))), (F.col("job_id") % 4 + 1).cast("int")))
    return _jobs(spark, sf).groupBy(queues.settle(code, F.col("attempts")).alias("outcome")).agg(F.count("*").alias("n"))


def job_fail_transition(spark, sf):
    reason = F.element_at(F.array(*map(F.lit, ("lock_wait", "post_commit", "permanent", "other"))), (F.col("job_id") % 4 + 1).cast("int"))
    return _jobs(spark, sf).select(queues.fail_transition(reason, F.col("attempts"), F.lit(8)).alias("t")).groupBy("t.status", "t.attempts").agg(F.count("*").alias("n"))


def job_retention(spark, sf):
    gone = queues.expired(_jobs(spark, sf), now(), "finished_at", {"done": 5, "failed": 10})
    return gone.groupBy("status").agg(F.count("*").alias("n"), F.max("job_id").alias("last_id"))


def next_due_delay(spark, sf):
    return queues.next_due_delay(_jobs(spark, sf).where("status = 'queued'"), F.lit("2024-01-01 00:00:00").cast("timestamp"), 60)


def outbox_counts(spark, sf):
    flying = F.col("status").isin("queued", "running", "retry_wait")
    return _jobs(spark, sf).agg(F.count_if(flying).alias("in_flight"), F.timestamp_diff("SECOND", F.min(F.when(flying, F.col("created_at"))), now()).alias("lag_seconds"))


def paged_list(spark, sf):
    return queues.page(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 20, 25)


def latest_row(spark, sf):
    newest = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("job_id"))
    return _jobs(spark, sf).withColumn("nth", F.row_number().over(newest)).where("nth = 1").select("user_id", "job_id", "status")


def join_jobs_conversations(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last_turn"))
    return _jobs(spark, sf).join(c, F.col("user_id") == F.col("conv_id"), "left").where("status = 'queued'").select("job_id", "user_id", "last_turn")


def anti_exists_retention(spark, sf):
    live = table(spark, sf, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey"))
    return queues.without_live(table(spark, sf, "customer"), live, "c_custkey").select("c_custkey", "c_name")


def semi_in_subquery(spark, sf):
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").alias("version"))
    return queues.superseded(rows, "o_custkey", "version").groupBy("o_custkey").agg(F.count("*").alias("older"))


def ingest_versioning(spark, sf):
    held = table(spark, sf, "orders").where("o_orderstatus <> 'O'").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("version"), F.col("o_orderpriority").alias("digest"))
    incoming = table(spark, sf, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("version"), F.col("o_orderpriority").alias("digest"))
    return queues.ingest_verdicts(incoming, held).groupBy("verdict").agg(F.count("*").alias("n"))


def stale_verdict_join(spark, sf):
    uuid = lambda c: F.concat(F.lit("u"), (F.col(c) % 5).cast("string"))
    outbox = _jobs(spark, sf).select("job_id", F.col("user_id").alias("session_key"), uuid("job_id").alias("session_uuid"))
    sessions = table(spark, sf, "customer").select(F.col("c_custkey").alias("session_key"), uuid("c_custkey").alias("session_uuid"))
    dead = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("session_key"), uuid("s_suppkey").alias("session_uuid"))
    return queues.stale_verdicts(outbox, sessions, dead).groupBy("verdict").agg(F.count("*").alias("n"))


def delete_barrier_anti(spark, sf):
    deletes = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("session_key"), F.concat(F.lit("u"), (F.col("s_suppkey") % 3).cast("string")).alias("session_uuid"))
    flying = _jobs(spark, sf).where("status = 'running'").select(F.col("user_id").alias("session_key"), F.when(F.col("job_id") % 4 == 0, "").otherwise(F.concat(F.lit("u"), (F.col("job_id") % 3).cast("string"))).alias("session_uuid"))
    return queues.delete_barrier(deletes, flying).select("session_key", "session_uuid")


def ab_paired_join(spark, sf):
    cases = table(spark, sf, "labels")
    before, after = cases.select(F.col("doc_id").alias("case_id"), (F.col("quality") == 1).alias("passed")), cases.select(F.col("doc_id").alias("case_id"), (F.col("toxic") == 0).alias("passed"))
    return evaluation.ab_delta(before, after).groupBy("change").agg(F.count("*").alias("n"))


def ab_missing_cases(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return docs.join(table(spark, sf, "labels"), "doc_id", "left_anti").groupBy("lang").agg(F.count("*").alias("missing"))


def category_pass_rate(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang", "source"), "doc_id")
    return rows.groupBy("lang").agg(F.count("*").alias("cases"), F.round(F.avg(F.col("quality").cast("double")), 9).alias("rate"))


def security_regressions(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    rate = lambda c: rows.groupBy(F.col("source").alias("category")).agg(F.avg(c.cast("double")).alias("rate"))
    return evaluation.security_regressions(rate(F.col("quality")), rate(1 - F.col("toxic")).where("category <> 'src3'")).select("category", "finding")


def judge_disagreement(spark, sf):
    return table(spark, sf, "labels").agg(F.round(F.avg((F.col("quality") != 1 - F.col("toxic")).cast("double")), 9).alias("disagreement"))


def case_pass(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_discount").alias("a") * 10, F.when(F.col("l_tax") > 0.02, F.col("l_tax") * 12.5).alias("b"), (F.col("l_returnflag") == "R").alias("error"), (F.col("l_linestatus") == "F").alias("critical"), (F.col("l_quantity") > 10).alias("critical_ok")).toDF("a", "b", "error", "critical", "critical_ok")
    return evaluation.case_pass(rows, ["a", "b"]).groupBy("passed").agg(F.count("*").alias("n"))


def auc_pairwise(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", F.length("text").alias("score")), "doc_id")
    return evaluation.auc(rows.select("score", (F.col("quality") == 1).alias("positive"))).select(F.round("auc", 9).alias("auc"))


def wald_ci(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").withColumn("hit", F.col("quality") == 1)
    return evaluation.wald_interval(rows, "lang", "hit").select("lang", "n", *[F.round(c, 9).alias(c) for c in ("p", "low", "high")])


def percentiles(spark, sf):
    e, events = evaluation, table(spark, sf, "events")
    places = e.values_at(events, "event_type", "value", {"p1": e.nearest_place(0.95), "p2": e.rounded_place(0.95), "p4": e.floor_place(0.9)})
    smooth = events.groupBy("event_type").agg(F.round(e.percentile_linear("value", 0.95), 9).alias("p3"), F.round(F.median("value"), 9).alias("median"))
    return places.join(smooth, "event_type").select("event_type", "p1", "p2", "p3", "p4", "median")


def rejection_grid(spark, sf):
    rows = table(spark, sf, "lineitem").select((F.col("l_returnflag") == "A").alias("positive"), (F.col("l_quantity") / 50).alias("top1"), F.when(F.col("l_tax") > 0.01, F.col("l_discount")).alias("gap"), (F.col("l_tax") * 10).alias("coverage"))
    steps = lambda name, values: spark.createDataFrame([(v,) for v in values], f"{name} double")
    grid = steps("t_top1", [0.0, 0.2, 0.4]).crossJoin(steps("t_gap", [0.0, 0.05])).crossJoin(steps("t_coverage", [0.0, 0.3])).withColumn("ord", F.lit(0))
    return evaluation.rejection_grid(rows, grid).select("t_top1", "t_gap", "t_coverage", F.round("negative_rejected", 9).alias("negative_rejected"), F.round("positive_rejected", 9).alias("positive_rejected"), "feasible")


def release_gates(spark, sf):
    summary = table(spark, sf, "events").groupBy("event_type").agg(F.avg("value").alias("recall"), F.percentile("value", F.lit(0.95)).alias("p95"), F.count_if(F.col("value") < 0).alias("degraded"))
    return evaluation.release_gates(summary, {"recall": 50.0}, 150.0).select("event_type", "failed")


def llm_usage_cost(spark, sf):
    calls = table(spark, sf, "events").select(F.col("event_type").alias("model"), (F.col("event_id") % 1000).alias("prompt_tokens"), (F.col("event_id") % 300).alias("completion_tokens"))
    prices = spark.createDataFrame([("click", 0.5, 1.5), ("view", 0.25, 1.0)], "model string, prompt_price double, completion_price double")
    return commerce.usage_cost(calls, prices).withColumn("cost", F.round("cost", 6))


def dataset_stats(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("users"), F.round(F.avg("o_totalprice"), 4).alias("mean_total"))


def dataset_quota(spark, sf):
    n = table(spark, sf, "documents").agg(F.greatest(F.lit(2), F.floor(F.count("*") * 0.02).cast("int") + 1).alias("quota"))
    return table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n")).crossJoin(F.broadcast(n)).where("n > quota")


def online_quality(spark, sf):
    recent = table(spark, sf, "events").where(F.col("ts") >= now() - F.expr("INTERVAL 72 HOURS"))
    return recent.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg((F.col("value") > 10).cast("double")), 9).alias("resolved"))


def turn_sessionize(spark, sf):
    return chat.sessionize(messages(spark, sf)).select("session", "seq", "msg_index")


def last_final_answer(spark, sf):
    return chat.turns(messages(spark, sf))


def suffix_budget(spark, sf):
    return chat.suffix_budget(messages(spark, sf), 120).select("session", "seq")


def evidence_nearest_customer(spark, sf):
    return chat.nearest_customer(messages(spark, sf)).select("session", "seq", "previous_seq", "next_seq")


def watermark_consume(spark, sf):
    marks = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("session")).agg(F.floor(F.max("turn") / 3).alias("mark"), (F.max("turn") - 1).alias("through_seq"))
    return chat.consume(messages(spark, sf), marks).select("session", "seq")


def mine_filter(spark, sf):
    t = chat.turns(messages(spark, sf)).withColumn("confidence", F.when(F.col("session") % 5 == 0, 0.5).otherwise(0.9)).withColumn("requires_human", F.col("session") % 7 == 0).withColumn("n_sources", F.col("msg_index") % 3)
    return mining.stage_report(mining.mine_filter(t))


def judge_gate(spark, sf):
    rows = table(spark, sf, "labels")
    gate = mining.judge_gate(F.col("quality") == 1, (F.col("doc_id") % 10) / 10.0, F.col("toxic") == 0, F.col("doc_id") % 11 == 0)
    return rows.groupBy(gate.alias("decision")).agg(F.count("*").alias("n"))


def human_score(spark, sf):
    s = mining.human_scores((F.col("doc_id") % 10) / 10.0, F.col("quality").cast("double"))
    cls = mining.human_classify(F.col("doc_id") % 13 == 0, F.col("doc_id") % 5 == 0, F.col("toxic") == 1, F.col("doc_id") % 7 == 0, F.col("quality") == 1, s["composite"])
    return table(spark, sf, "labels").select("doc_id", F.round(s["novelty"], 9).alias("novelty"), F.round(s["composite"], 9).alias("composite"), cls.alias("decision"))


def judge_topn(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("source_score"), F.length("o_orderpriority").alias("confidence"), F.col("o_orderkey").alias("ord"))
    return mining.judge_first(rows).select("o_orderkey")


def cap_publish(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("ord"))
    return mining.cap_publish(rows, 5).groupBy("decision").agg(F.count("*").alias("n"))


def ledger_aging(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "aging").otherwise("done").alias("status"), F.col("o_orderdate").cast("date").alias("created"))
    return mining.age_ledger(rows, F.lit("1998-01-01").cast("date")).groupBy("status", "new_status").agg(F.count("*").alias("n"))


def stratified_sample(spark, sf):
    return mining.stratified(table(spark, sf, "documents").select("doc_id", "source", "lang"), "lang", "doc_id", 3, ["es"]).select("doc_id", "lang")


def corpus_reference_check(spark, sf):
    refs = table(spark, sf, "part").select(F.substring("p_name", 1, 7).alias("ref")).distinct()
    return mining.unknown_references(refs, table(spark, sf, "nation").select(F.col("n_name").alias("name")))


def theta_self_join_pairs(spark, sf):
    return retrieval.cosine_pairs(vectors(spark, sf), 0.35)


def dice_scores(spark, sf):
    c = table(spark, sf, "conversations")
    first = c.where("turn = 0").select("conv_id", F.col("text").alias("opening"))
    return c.where("turn > 0").join(first, "conv_id").select("conv_id", "turn", F.round(dice(F.col("opening"), F.col("text")), 9).alias("dice"))


def score_fact(spark, sf):
    f = _facts(spark, sf)
    return f.select("fact_id", F.round(memory.fact_score(F.lit("the and of"), F.col("content"), F.col("category"), F.col("created_at"), now()), 9).alias("score"), F.round(memory.fused_score(F.lit("the and of"), F.col("content"), F.when(F.col("fact_id") % 2 == 0, 0.5), F.col("category"), F.col("created_at"), now()), 9).alias("fused"))


def select_facts(spark, sf):
    return memory.select_facts(_facts(spark, sf), F.lit("the and of"), now(), k=3).select("user_id", "fact_id", "rank")


def facts_active_at(spark, sf):
    return memory.active_at(_facts(spark, sf), F.lit("2023-10-01 00:00:00").cast("timestamp")).groupBy("category").agg(F.count("*").alias("n"))


def prune_versions(spark, sf):
    return memory.prune_versions(_facts(spark, sf), now()).groupBy("status").agg(F.count("*").alias("n"))


def active_cap(spark, sf):
    return memory.cap_active(_facts(spark, sf), 3).groupBy("status").agg(F.count("*").alias("n"))


def retention_keep_last_n(spark, sf):
    return memory.keep_last(_facts(spark, sf), "user_id", "fact_id", 2).select("user_id", "fact_id")


def embedding_backfill(spark, sf):
    known = _facts(spark, sf).where("fact_id % 3 = 0").select("user_id", "fact_id", F.when(F.col("fact_id") % 2 == 0, "m1").otherwise("m2").alias("model"))
    return memory.backfill(_facts(spark, sf), known, "m1").select("fact_id")


def duplicate_clusters(spark, sf):
    links = retrieval.cosine_links(vectors(spark, sf), 0.35)
    return memory.duplicate_clusters(links).groupBy("cluster").agg(F.count("*").alias("n"))


def sliding_window_limit(spark, sf):
    return windows.sliding_limit(table(spark, sf, "events"), 3600, 2).select("event_id", "hits", "allowed")


def sliding_window_limit_in_order(spark, sf):
    return windows.sliding_limit_stateful(table(spark, sf, "events"), 3600, 2)


def idle_session_gap(spark, sf):
    return windows.sessions(table(spark, sf, "events"), "6 hours")


def promql_rate(spark, sf):
    return windows.rate(table(spark, sf, "events"), "1 hour", 3600).withColumn("total", F.round("total", 6)).withColumn("rate", F.round("rate", 9))


def sliding_windows(spark, sf):
    return windows.sliding_count(table(spark, sf, "events"), "6 hours", "2 hours")


def histogram_buckets(spark, sf):
    return windows.histogram(table(spark, sf, "events")).where(F.col("le") < float("inf"))


def promql_histogram_quantile(spark, sf):
    return windows.histogram_quantile(windows.histogram(table(spark, sf, "events")), 0.9).withColumn("quantile", F.round("quantile", 6))


def promql_topk_24h(spark, sf):
    return windows.top_users(table(spark, sf, "events"), 3).select("day", "user_id", "rank")


def _hourly(spark, sf):
    return table(spark, sf, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("n"))


def promql_spike(spark, sf):
    return windows.spikes(_hourly(spark, sf), 2.0).select("event_type", "hour", "n", F.round("mean_before", 9).alias("mean_before"))


def alert_for(spark, sf):
    return windows.held_for(_hourly(spark, sf), F.col("n") >= 3, 3, "event_type", "hour")


def order_get(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderstatus").alias("status"))
    asked = table(spark, sf, "lineitem").select(F.when(F.col("l_linenumber") == 1, -F.col("l_orderkey")).otherwise(F.col("l_orderkey")).alias("order_id"), F.col("l_suppkey").alias("user_id"))
    return commerce.lookup_orders(asked, orders).groupBy("code", "status").agg(F.count("*").alias("n"))


def order_list_limit(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("created_at"))
    return commerce.newest_orders(orders, 3).select("user_id", "order_id", "total", "nth")


def order_logistics_join(spark, sf):
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("shipped"), F.count("*").alias("lines"))
    return table(spark, sf, "orders").join(lines, "o_orderkey", "left").select("o_orderkey", "o_orderstatus", "shipped", "lines")


def sla_breach(spark, sf):
    tickets = _jobs(spark, sf)
    end = F.when(F.col("status") == "done", F.col("finished_at")).otherwise(now())
    return tickets.where(end > F.col("created_at") + F.expr("INTERVAL 30 MINUTES")).groupBy("status").agg(F.countDistinct("job_id").alias("n"))


def channel_poll(spark, sf):
    return table(spark, sf, "events").where("event_id > 500").orderBy("event_id").limit(100).select("event_id", "event_type")


def union_routes(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.lit("customer").alias("kind"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.lit("supplier").alias("kind"))
    return c.unionByName(s).groupBy("kind").agg(F.count("*").alias("n"), F.max("key").alias("last"))


def intersect_except(spark, sf):
    had = table(spark, sf, "orders").select("o_custkey").distinct()
    every = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"))
    return every.intersect(had).agg(F.count("*").alias("n")).withColumn("kind", F.lit("with")).unionByName(every.exceptAll(had).agg(F.count("*").alias("n")).withColumn("kind", F.lit("without")))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    job_stats, eval_job_stats, queue_claim, backoff, outbox_settle, job_fail_transition, job_retention, next_due_delay, outbox_counts, paged_list, latest_row,
    join_jobs_conversations, anti_exists_retention, semi_in_subquery, ingest_versioning, stale_verdict_join, delete_barrier_anti, ab_paired_join, ab_missing_cases,
    category_pass_rate, security_regressions, judge_disagreement, case_pass, auc_pairwise, wald_ci, percentiles, rejection_grid, release_gates, llm_usage_cost, dataset_stats,
    dataset_quota, online_quality, turn_sessionize, last_final_answer, suffix_budget, evidence_nearest_customer, watermark_consume, mine_filter, judge_gate, human_score,
    judge_topn, cap_publish, ledger_aging, stratified_sample, corpus_reference_check, theta_self_join_pairs, dice_scores, score_fact, select_facts, facts_active_at, prune_versions,
    active_cap, retention_keep_last_n, embedding_backfill, duplicate_clusters, sliding_window_limit, sliding_window_limit_in_order, idle_session_gap, promql_rate, sliding_windows,
    histogram_buckets, promql_histogram_quantile, promql_topk_24h, promql_spike, alert_for, order_get, order_list_limit, order_logistics_join, sla_breach, channel_poll, union_routes,
    intersect_except,
)}
