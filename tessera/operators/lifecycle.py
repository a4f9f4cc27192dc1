"""States of jobs, uploads and documents, evidence rules, and folds of evaluation and memory rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.safety import mask_phone, memory_injection
from tessera.operators.retrieval import top_k

#: Where a document's state may go.
TRANSITIONS = {
    "uploading": ("queued", "validating", "failed", "cancelled"),
    "queued": ("validating", "uploading", "failed", "cancelled"),
    "validating": ("indexing", "queued", "uploading", "failed", "cancelled"),
    "indexing": ("indexed", "queued", "uploading", "failed"),
    "indexed": ("deleting", "delete_queued"),
    "delete_queued": ("deleting", "indexed"),
    "deleting": ("deleted", "indexed", "delete_queued"),
}


def transition_allowed(before: Column, after: Column) -> Column:
    """Whether a document may go from one state to the other; false from states without an exit, and for nulls."""
    allowed = [(before == state) & after.isin(*next_) for state, next_ in TRANSITIONS.items()]
    out = allowed[0]
    for rule in allowed[1:]:
        out |= rule
    return F.coalesce(out, F.lit(False))


def cancel(jobs: DataFrame) -> DataFrame:
    """Adds new_status: jobs (status, doc_status) that wait, of documents that wait too, are cancelled."""
    waits = F.col("status").isin("queued", "retry_wait") & F.col("doc_status").isin("queued", "uploading", "validating")
    return jobs.withColumn("new_status", F.when(waits, "cancelled").otherwise(F.col("status")))


def retry(jobs: DataFrame) -> DataFrame:
    """Adds new_status and new_attempts: ended jobs (status, attempts, retryable) that may be retried are queued from nought."""
    again = F.col("status").isin("failed", "blocked") & F.coalesce("retryable", F.lit(False))
    return jobs.withColumn("new_status", F.when(again, "queued").otherwise(F.col("status"))).withColumn("new_attempts", F.when(again, 0).otherwise(F.col("attempts")))


def replay(rows: DataFrame) -> DataFrame:
    """Dead letters go back to pending, from nought; others stay."""
    dead = F.col("status") == "dead_letter"
    return rows.withColumn("new_status", F.when(dead, "pending").otherwise(F.col("status"))).withColumn("new_attempts", F.when(dead, 0).otherwise(F.col("attempts")))


def expire_orphans(uploads: DataFrame, now: Column) -> DataFrame:
    """Uploads (status, expires_at) that nobody finished in time are cancelled."""
    late = (F.col("status") == "uploading") & (F.col("expires_at") < now)
    return uploads.withColumn("new_status", F.when(late, "cancelled").otherwise(F.col("status")))


def collectable(uploads: DataFrame, now: Column, kept: dict[str, str], limit: int) -> DataFrame:
    """At most ``limit`` uploads (doc_id, status, changed_at) whose state has lasted longer than its class is kept, oldest first."""
    past = F.lit(False)
    for status, interval in kept.items():
        past |= (F.col("status") == status) & (F.col("changed_at") < now - F.expr(f"INTERVAL {interval}"))
    return uploads.where(past).orderBy("changed_at", "doc_id").limit(limit)


#: Requests without a key are dealt into so many parts.
NULL_PARTS = 4096


def refund_lookup(asked: DataFrame, applications: DataFrame, orders: DataFrame) -> DataFrame:
    """asked (ask_id, user_id, application_id, order_id) with code and n: by an application or by an order, not both; both must belong to the user."""
    one = F.col("application_id").isNotNull() != F.col("order_id").isNotNull()
    apps = applications.select(F.col("application_id").alias("_app"), F.col("user_id").alias("_app_user"))
    owned = orders.select(F.col("order_id").alias("_order"), F.col("user_id").alias("_order_user"))
    per_order = applications.groupBy(F.col("order_id").alias("_of")).agg(F.count("*").alias("_n"))
    # Requests without a key find nothing: a number instead keeps a join from sending them all to one task.
    spread = lambda key: F.coalesce(F.col(key), F.pmod(F.xxhash64("ask_id"), F.lit(NULL_PARTS)))
    beside = lambda key, held: (spread(key) == F.col(held)) & F.col(key).isNotNull()
    joined = asked.join(apps, beside("application_id", "_app"), "left").join(owned, beside("order_id", "_order"), "left").join(per_order, beside("order_id", "_of"), "left")
    mine = F.when(F.col("application_id").isNotNull(), F.col("_app_user") == F.col("user_id")).otherwise(F.col("_order_user") == F.col("user_id"))
    code = F.when(~one, "invalid").when(F.coalesce(mine, F.lit(False)), "ok").otherwise("not_found")
    n = F.when(code == "ok", F.when(F.col("application_id").isNotNull(), 1).otherwise(F.coalesce("_n", F.lit(0)))).otherwise(0)
    return joined.select("ask_id", code.alias("code"), n.cast("long").alias("n"))


def parent_or_self(body: Column, parent: Column, table_head: Column) -> Column:
    """A hit's text: its parent's, if that holds the body, or the body without the table head that was copied in front of it; else its own."""
    rest = F.when(body.startswith(table_head), F.btrim(F.substring(body, F.length(table_head) + 1, F.length(body))))
    held = (parent != "") & (body != "") & (parent.contains(body) | ((rest != "") & parent.contains(rest)))
    return F.when(F.coalesce(held, F.lit(False)), parent).otherwise(body)


def evidence_diagnostics(items: DataFrame) -> DataFrame:
    """Of each query's items (query_id, rank, score, source, tainted): items, tainted ones, best score and its lead, and sources in order; tainted items speak for nothing."""
    clean = items.where(~F.col("tainted"))
    placed = clean.withColumn("_nth", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "rank")))
    best = [F.max(F.when(F.col("_nth") == k, F.col("score"))) for k in (1, 2)]
    folded = placed.groupBy("query_id").agg(F.count("*").alias("n_items"), best[0].alias("top1"), (best[0] - best[1]).alias("gap"))
    seen = clean.groupBy("query_id", "source").agg(F.min("rank").alias("rank")).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "source")))["source"].alias("sources"))
    every = items.groupBy("query_id").agg(F.count_if("tainted").alias("tainted"))
    return every.join(folded, "query_id", "left").join(seen, "query_id", "left").withColumn("n_items", F.coalesce("n_items", F.lit(0)))


#: Labels before a rewritten query, talk about the task, and the most characters.
LABEL = r"(?i)^\s*(?:改写后?|查询|检索查询|rewrite)\s*[:：]\s*"
TALK = ("原样输出", "已自足", "无需改写", "不需要改写", "保持不变", "根据指令", "无法改写", "作为ai", "作为一个ai")
MOST_REWRITTEN = 200


def rewritten_query(query: Column, answer: Column) -> Column:
    """The first line of an answer that has text, without a label in front and quotes, if it is a plausible rewrite; else the query.

    Not plausible: the query itself, talk about the task (TALK), more than MOST_REWRITTEN characters, or more than both 64 and four times the query.
    """
    line = F.regexp_extract(F.coalesce(answer, F.lit("")), r"(?m)^\s*(\S.*?)\s*$", 1)
    line = F.btrim(F.btrim(F.btrim(F.regexp_replace(line, LABEL, "")), F.lit("`\"'“”‘’")))
    talk = F.lower(line).rlike("|".join(TALK))
    good = (line != "") & (line != query) & ~talk & (F.length(line) <= F.least(F.lit(MOST_REWRITTEN), F.greatest(F.lit(64), 4 * F.length(query))))
    return F.when(good, line).otherwise(query)


def rerank_scores(answers: DataFrame) -> DataFrame:
    """(query_id, place, score) from JSON answers (query_id, answer): objects with results, or lists, of objects or of pairs; malformed items are left out."""
    v = F.try_parse_json("answer")
    get = lambda path, kind: F.try_variant_get(v, path, kind)
    as_objects = F.coalesce(get("$.results", "array<variant>"), get("$", "array<variant>"))
    item = F.col("item")
    pick = lambda paths, kind: F.coalesce(*[F.try_variant_get(item, p, kind) for p in paths])
    place, score = pick(["$.index", "$[0]"], "int"), pick(["$.relevance_score", "$.score", "$[1]"], "double")
    found = answers.select("query_id", F.explode(as_objects).alias("item")).select("query_id", place.alias("place"), score.alias("score"))
    return found.where("place is not null and score is not null")


def final_multi_search(routes: DataFrame, k: int, least: float, rrf_k: int = 60) -> DataFrame:
    """Hits of several queries for one question (question, query, chunk_id, parent_id, rank, score, degraded): gate by query, fuse ranks, first hit of each parent, at most k.

    Each row names the queries that found its parent, and whether any route of the question was degraded.
    """
    group = F.coalesce(F.nullif(F.col("parent_id"), F.lit("")), F.concat(F.lit("#"), F.col("chunk_id").cast("string")))
    gated = routes.where(F.col("score") >= least).withColumn("_group", group)
    # A few terms for each chunk, one for each query; sorted, so that their sum does not depend on their order.
    terms = F.sort_array(F.collect_list(1 / (F.lit(float(rrf_k)) + F.col("rank"))))
    fused = gated.groupBy("question", "_group", "chunk_id").agg(F.round(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x), 12).alias("fused"))
    first = fused.withColumn("_nth", F.row_number().over(Window.partitionBy("question", "_group").orderBy(F.desc("fused"), "chunk_id"))).where("_nth = 1").drop("_nth")
    found_by = gated.groupBy("question", "_group").agg(F.array_join(F.array_sort(F.collect_set(F.col("query").cast("string"))), ",").alias("queries"))
    degraded = routes.groupBy("question").agg(F.bool_or("degraded").alias("degraded"))
    best = top_k(first, k, [F.desc("fused"), F.asc("chunk_id")], "question")
    return best.join(found_by, ["question", "_group"]).join(degraded, "question").select("question", "chunk_id", "rank", "fused", "queries", "degraded")


def replaces(side: Column, path: Column, quality: Column, old_quality: Column) -> Column:
    """The file that a near duplicate replaces, or null: only a hit on the question's side, on a file under evolved/, that is no better; a missing old quality counts as -1."""
    good = (side == "question") & path.startswith("evolved/") & (quality >= F.coalesce(old_quality, F.lit(-1.0)))
    return F.when(good, F.substring(path, F.lit(len("evolved/") + 1), F.length(path)))


def final_duplicates(questions: DataFrame, answers: DataFrame, least: float, tolerance: float = 1e-4) -> DataFrame:
    """(query_id, side, chunk_id): the nearest neighbours (query_id, chunk_id, score; one for each query) that are near enough; the question's side is asked first."""
    near = lambda df, side, order: df.where(F.col("score") >= least - tolerance).select("query_id", "chunk_id", F.lit(side).alias("side"), F.lit(order).alias("_o"))
    both = near(questions, "question", 0).unionByName(near(answers, "answer", 1))
    return both.groupBy("query_id").agg(F.min_by(F.struct("side", "chunk_id"), "_o").alias("_")).select("query_id", "_.side", "_.chunk_id")


def candidate_clusters(clusters: DataFrame, legacy: DataFrame, limit: int) -> DataFrame:
    """(cluster, size, place) of clusters (node, cluster) and of legacy facts (node) that lie in none: single ones first, then larger ones."""
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("size"))
    alone = legacy.join(clusters, "node", "left_anti").select(F.col("node").alias("cluster"), F.lit(1).cast("long").alias("size"))
    order = [F.when(F.col("size") == 1, 0).otherwise(1), F.desc("size"), F.asc("cluster")]
    return alone.unionByName(sizes).orderBy(*order).limit(limit).withColumn("place", F.row_number().over(Window.orderBy(*order)))


def new_summaries(summaries: DataFrame) -> DataFrame:
    """Summaries (session, summary, seq): of equal ones of a session only the first."""
    return summaries.groupBy("session", "summary").agg(F.min("seq").alias("seq"))


def evidence_gate(mutations: DataFrame, messages: DataFrame) -> DataFrame:
    """Mutations (session, fact_id, fact_key, content, evidence, ...) that may be kept, with keys in lower case, trimmed, and phone numbers masked in content and evidence.

    The trimmed evidence must stand word for word in the session's user messages (session, role, text, seq), which count as joined by line ends, so it may run from one into
    the next; without any user text every evidence passes. Contents that hold an injection, or a lasting instruction under a free key, go. Nulls count as empty.
    Lines meet lines: a session is never joined into one text.
    """
    trimmed = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")
    clean = mutations.withColumns({"fact_key": F.lower(trimmed(F.col("fact_key"))), "content": trimmed(F.col("content")), "evidence": trimmed(F.col("evidence"))})
    clean = clean.where(~memory_injection(F.col("fact_key"), F.col("content")))
    said = messages.where("role = 'user'").select("session", "seq", F.coalesce("text", F.lit("")).alias("_text"))
    parts = F.split("evidence", "\n")
    wanted = clean.where("evidence <> ''").select("session", "evidence").distinct()
    whole = wanted.where(F.size(parts) == 1).join(said, "session").where(F.contains("_text", "evidence")).select("session", "evidence")
    # Evidence of several lines: the first ends a line, the last starts one, those between are whole, all in a row.
    lines = said.select("session", "seq", F.posexplode(F.split("_text", "\n")).alias("_pos", "_line"))
    lines = lines.withColumn("_n", F.row_number().over(Window.partitionBy("session").orderBy("seq", "_pos")))
    asked = wanted.where(F.size(parts) > 1).select("session", "evidence", F.size(parts).alias("_size"), F.posexplode(parts).alias("_i", "_part"))
    fits = F.when(F.col("_i") == 0, F.endswith("_line", "_part")).when(F.col("_i") == F.col("_size") - 1, F.startswith("_line", "_part")).otherwise(F.col("_line") == F.col("_part"))
    met = asked.join(lines, "session").where(fits).groupBy("session", "evidence", "_size", (F.col("_n") - F.col("_i")).alias("_start")).agg(F.count("*").alias("_met"))
    held = whole.unionByName(met.where("_met = _size").select("session", "evidence")).distinct().withColumn("_held", F.lit(True))
    silent = said.where("_text <> ''").select("session").distinct().withColumn("_spoke", F.lit(True))
    kept = clean.join(held, ["session", "evidence"], "left").join(silent, "session", "left").where("_held OR _spoke IS NULL").drop("_held", "_spoke")
    return kept.withColumns({"content": mask_phone(F.col("content")), "evidence": mask_phone(F.col("evidence"))})


def rules_aggregate(cases: DataFrame) -> DataFrame:
    """Totals of cases (passed, process, result, tokens, critical), with means that skip nulls."""
    n = F.count("*")
    mean = lambda c: F.round(F.avg(c), 4)
    return cases.agg(
        n.alias("total"), F.count_if("passed").alias("passed"), F.round(F.try_divide(F.count_if("passed"), n), 4).alias("pass_rate"), mean("process").alias("process"), mean("result").alias("result"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.count("critical").alias("critical_total"), F.count_if("critical").alias("critical_passed"),
    )


def counter_increase(samples: DataFrame, by: str, width: str) -> DataFrame:
    """(by, start, increase) of a counter's samples (by, ts, value): the sum of its rises in each window; a fall is a restart, which adds the new value."""
    before = F.lag("value").over(Window.partitionBy(by).orderBy("ts", "value"))
    rise = F.when(F.col("_before").isNull(), 0.0).when(F.col("value") >= F.col("_before"), F.col("value") - F.col("_before")).otherwise(F.col("value"))
    return samples.withColumn("_before", before).groupBy(by, F.window("ts", width)["start"].alias("start")).agg(F.sum(rise).alias("increase"))


#: What the documents of products say of themselves, and the sections of each.
PRODUCT_KIND, PRODUCT_SINCE = "product", "2024-06-01"
PRODUCT_SECTIONS = ("## 商品信息", "## 商品卖点", "## 规格参数", "## 售后与配送")
PRODUCT_SERVICE = "支持七天无理由退换（以平台售后政策为准）；下单后 48 小时内发货。"


def product_doc(product_id: Column, name: Column, category: Column, price: Column, stock: Column, description: Column, specs: Column) -> Column:
    """A product as Markdown with front matter; specs are an array of structs (key, value). Without a name the id is the title; other nulls are empty, a price or stock is 0."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    price, stock = F.coalesce(price.cast("double"), F.lit(0.0)), F.coalesce(stock.cast("long"), F.lit(0))
    # Short decimals, never an exponent.
    plain = F.regexp_replace(F.regexp_replace(price.cast("decimal(30, 10)").cast("string"), "0+$", ""), r"\.$", ".0")
    line = lambda label, value: F.concat(F.lit(label), value)
    table = F.transform(F.coalesce(specs, F.array().cast("array<struct<key:string,value:string>>")), lambda s: F.concat(F.lit("| "), text(s["key"]), F.lit(" | "), text(s["value"]), F.lit(" |")))
    head = [
        F.lit("---"), F.lit("status: active"), F.lit(f"authority: {PRODUCT_KIND}"), F.lit(f"namespace: {PRODUCT_KIND}"), line("product_id: ", product_id), line("category: ", text(category)),
        line("price: ", plain), F.lit(f"effective_date: {PRODUCT_SINCE}"), F.lit("---"), F.lit(""), line("# ", F.coalesce(name, product_id)), F.lit(""),
        F.lit(PRODUCT_SECTIONS[0]), line("- 商品编号：", product_id), line("- 类目：", text(category)), line("- 价格：¥", F.format_string("%.2f", price)),
        F.concat(F.lit("- 库存："), stock.cast("string"), F.lit(" 件（"), F.when(stock > 0, "有货").otherwise("缺货"), F.lit("）")), F.lit(""),
        F.lit(PRODUCT_SECTIONS[1]), text(description), F.lit(""), F.lit(PRODUCT_SECTIONS[2]), F.lit("| 参数 | 值 |"), F.lit("| --- | --- |"),
    ]
    tail = [F.lit(""), F.lit(PRODUCT_SECTIONS[3]), F.lit(PRODUCT_SERVICE), F.lit("")]
    return F.array_join(F.concat(F.array(*head), table, F.array(*tail)), "\n")


def in_product_namespace(authority: Column, path: Column) -> Column:
    """Whether a chunk belongs to the product documents: their authority, and a plain .md file name."""
    rel = F.regexp_replace(F.coalesce(path, F.lit("")), r"\\", "/")
    return (F.lower(F.btrim(F.coalesce(authority, F.lit("")))) == "product") & rel.endswith(".md") & ~rel.contains("/")
