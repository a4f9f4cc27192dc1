"""Queries of page layout, digests of tool results and drift in batches, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import digests
from tessera.operators import batches
from tessera.plans._tables import Query, table
from tessera.sources import layout


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as pages of a few papers: the first two lines of each are its speakers, sizes follow the lengths."""
    c = table(spark, sf, "conversations")
    text = F.when(F.col("turn") == 0, F.concat(F.lit(" "), "role")).when(F.col("turn") == 1, F.col("role")).when(F.col("turn") == 4, "  ").otherwise(F.col("text"))
    rows = c.select((F.col("conv_id") % 12).alias("doc"), F.col("conv_id").alias("page"), F.col("turn").alias("line"), text.alias("text"))
    return rows.withColumn("size", 10 + F.coalesce(F.length("text"), F.lit(0)) % 17 * 0.5)


def pdf_layout(spark: SparkSession, sf: str) -> DataFrame:
    return layout.marked_lines(_lines(spark, sf)).select("doc", "page", "line", "level", "margin", "rendered")


def pdf_pages(spark: SparkSession, sf: str) -> DataFrame:
    return layout.page_texts(_lines(spark, sf))


def tool_digest(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as results of six kinds of tools, one of them broken."""
    o, key = table(spark, sf, "orders"), F.col("o_orderkey").cast("string")
    kind, said = F.col("o_orderkey") % 6, F.col("o_orderpriority")
    tool = F.when(kind == 0, "query_order").when(kind == 1, "query_refund_application").when(kind == 2, "load_skill").when(kind == 5, "query_product").otherwise("some_new_tool")
    text = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    product = text('{"name":"', said, '","price":', key, ',"stock":0,"product_id":1}')
    content = (
        F.when(kind == 0, text('{"order":{"order_id":"O', key, '","status":"', F.repeat(said, F.lit(5)), '","total":', key, '.50,"items":[{"name":"', said, '"}]}}'))
        .when(kind == 1, text('{"success":true,"application_id":"A', key, '","status":"","message":null,"code":7}')).when(kind == 2, text('{"success":false,"skill_name":"s","error":"', said, '"}'))
        .when(kind == 3, text('{"z":', key, ',"n":{"x":1},"a":"', said, '","b":[1],"c":null}')).when(kind == 4, text("{broken ", F.repeat(said, F.lit(12))))
        .otherwise(text('{"products":[', product, ",", product, ",", product, "]}"))
    )
    return o.select("o_orderkey", digests.tool_digest(tool, content, 70).alias("digest"))


def tool_digest_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer's orders as one result; the ladder decides how much of the summaries stays."""
    o = table(spark, sf, "orders")
    entry = F.struct(F.concat(F.lit("O"), "o_orderkey").alias("order_id"), F.col("o_orderstatus").alias("status"), F.concat_ws(" ", "o_orderpriority", "o_orderpriority", "o_orderstatus", "o_orderpriority").alias("items_summary"))
    every = F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", entry.alias("e")))), lambda x: x["e"])
    held = o.groupBy("o_custkey").agg(every.alias("orders"), F.count("*").alias("count"))
    return held.select("o_custkey", digests.tool_digest(F.lit("list_user_orders"), F.to_json(F.struct("orders", "count")), 200).alias("digest"))


def _items(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        (F.col("o_custkey") % 40).alias("batch_id"), key.alias("candidate_id"), F.when(key % 19 > 0, key % 3).alias("candidate_revision"), F.lit(1).alias("source_version"),
        F.concat(F.lit('say "'), "o_orderpriority", F.lit('"')).alias("question"), F.concat("o_orderpriority", F.lit("\n\té\\")).alias("answer"), (key % 100 / 100.0).alias("value_score"),
        F.col("o_orderstatus").alias("classification"), F.when(key % 2 == 0, F.concat(F.lit("evolved/"), key)).alias("dedup_target_path"), F.lit("lead").alias("approved_by"), F.col("o_orderdate").alias("approved_at"),
    )


def approval_digest(spark: SparkSession, sf: str) -> DataFrame:
    return _items(spark, sf).select("candidate_id", batches.approval_digest().alias("digest"))


def revalidate_batch_drift(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as approved candidates in batches of customers, of which some changed afterwards."""
    o, c, key = table(spark, sf, "orders"), table(spark, sf, "customer"), F.col("o_orderkey")
    asked, made = c.select((F.col("c_custkey") % 45).alias("batch_id")), c.select((F.col("c_custkey") % 40).alias("batch_id")).distinct()
    items = _items(spark, sf).withColumn("approval_digest", F.when(F.col("candidate_id") % 11 == 0, "changed").otherwise(batches.approval_digest()))
    candidates = o.where(key % 13 > 0).select(
        key.alias("id"), F.when(key % 7 == 0, "published").otherwise("publish_queued").alias("status"), F.when(key % 17 > 0, F.col("o_custkey") % 40).alias("publish_batch_id"),
        F.when(key % 5 == 0, key % 3 + 1).otherwise(key % 3).alias("revision"), key.alias("conversation_id"),
    )
    conversations = o.where(key % 23 > 0).select(key.alias("id"), F.col("o_orderstatus").alias("source"), F.col("o_custkey").alias("external_conversation_id"), (key % 4).alias("source_version"))
    return batches.batch_drift(asked, made, items, candidates, conversations)


QUERIES: dict[str, Query] = {f.__name__: f for f in (pdf_layout, pdf_pages, tool_digest, tool_digest_orders, approval_digest, revalidate_batch_drift)}

_MARKED = r"""WITH raw AS (SELECT conv_id % 12 AS doc, conv_id AS page, turn AS line, CASE turn WHEN 0 THEN ' ' || role WHEN 1 THEN role WHEN 4 THEN '  ' ELSE text END AS text FROM conversations),
lines AS (SELECT *, 10 + coalesce(length(text), 0) % 17 * 0.5::DOUBLE AS size, regexp_replace(coalesce(text, ''), '\s+', '', 'g') AS norm FROM raw),
filled AS (SELECT * FROM lines WHERE norm <> ''),
sizes AS (SELECT doc, size, sum(length(regexp_replace(text, '^\s+|\s+$', '', 'g'))) AS weight, min(page * 1000 + line) AS met FROM filled GROUP BY doc, size),
body AS (SELECT doc, size AS body FROM sizes QUALIFY row_number() OVER (PARTITION BY doc ORDER BY weight DESC, met) = 1),
levels AS (SELECT doc, size, row_number() OVER (PARTITION BY doc ORDER BY size DESC)::INT AS level FROM sizes JOIN body USING (doc) WHERE size >= body + 1 QUALIFY level <= 6),
edge AS (SELECT DISTINCT doc, page, norm FROM (SELECT *, row_number() OVER (PARTITION BY doc, page ORDER BY line) AS a, row_number() OVER (PARTITION BY doc, page ORDER BY line DESC) AS z FROM filled) WHERE a <= 2 OR z <= 2),
pages AS (SELECT doc, count(DISTINCT page) AS pages FROM lines GROUP BY doc),
margins AS (SELECT doc, norm, true AS margin FROM edge JOIN pages USING (doc) GROUP BY doc, norm, pages HAVING count(*) >= greatest(3, ceil(pages * 0.6))),
marked AS (SELECT doc, page, line, CASE WHEN margin IS NULL AND norm <> '' THEN level END AS level, coalesce(margin, false) AS margin,
    CASE WHEN margin THEN NULL WHEN level IS NOT NULL AND norm <> '' THEN repeat('#', level) || ' ' || regexp_replace(text, '^\s+|\s+$', '', 'g') ELSE text END AS rendered
    FROM lines LEFT JOIN levels USING (doc, size) LEFT JOIN margins USING (doc, norm))"""
_CUT = "CASE WHEN length({0}) <= {1} THEN {0} ELSE left({0}, {1} - 1) || '…' END"
_PRODUCT = "'商品=' || o_orderpriority || ' price=' || o_orderkey || ' stock=0 product_id=1; '"

ORACLE_SQL: dict[str, str] = {
    "pdf_layout": f"{_MARKED} SELECT * FROM marked",
    "pdf_pages": f"{_MARKED} SELECT doc, page, coalesce(string_agg(coalesce(rendered, ''), chr(10) ORDER BY line) FILTER (WHERE NOT margin), '') AS text, bool_or(level IS NOT NULL) AS rebuilt FROM marked GROUP BY doc, page",
    "tool_digest": f"""WITH t AS (SELECT o_orderkey, o_orderkey % 6 AS kind, o_orderpriority, repeat(o_orderpriority, 5) AS status, '{{broken ' || repeat(o_orderpriority, 12) AS broken FROM orders),
        d AS (SELECT *, CASE kind WHEN 0 THEN 'order_id=O' || o_orderkey || ' status=' || {_CUT.format("status", 40)} || ' total=' || o_orderkey || '.5 tracking_number= 商品=' || o_orderpriority
            WHEN 1 THEN 'success=True application_id=A' || o_orderkey || ' code=7' WHEN 2 THEN '{{"error": "' || o_orderpriority || '", "skill_name": "s", "success": false}}'
            WHEN 3 THEN '{{"a": "' || o_orderpriority || '", "z": ' || o_orderkey || '}}' WHEN 5 THEN {_PRODUCT} || {_PRODUCT} || '…另有1项' END AS whole FROM t)
        SELECT o_orderkey, CASE WHEN kind = 4 THEN CASE WHEN length(broken) <= 70 THEN broken ELSE left(broken, 70) || '...' END ELSE {_CUT.format("whole", 70)} END AS digest FROM d""",
    "tool_digest_orders": f"""WITH o AS (SELECT *, concat_ws(' ', o_orderpriority, o_orderpriority, o_orderstatus, o_orderpriority) AS about, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
        e AS (SELECT o_custkey, r, n, step, between_, 'O' || o_orderkey || ' ' || o_orderstatus || CASE WHEN step = 0 THEN '' ELSE ' ' || {_CUT.format("about", "step")} END AS entry
            FROM o, (VALUES (60, ' | '), (30, ' | '), (16, ' | '), (8, ' | '), (0, ' | '), (0, '|')) AS ladder(step, between_) WHERE r <= 10),
        b AS (SELECT o_custkey, step * 10 + length(between_) AS place, CASE WHEN between_ = '|' THEN string_agg(entry, '|' ORDER BY r) ELSE string_agg(entry, ' | ' ORDER BY r) END || CASE WHEN max(n) > 10 THEN ' …另有' || (max(n) - 10) || '单' ELSE '' END AS body FROM e GROUP BY o_custkey, step, between_)
        SELECT o_custkey, {_CUT.format("body", 200)} AS digest FROM b QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY length(body) <= 200 DESC, CASE WHEN length(body) <= 200 THEN -place ELSE place END) = 1""",
    "approval_digest": """SELECT o_orderkey AS candidate_id, sha256('{"answer": ' || to_json(o_orderpriority || chr(10) || chr(9) || 'é\\') || ', "approved_at": "' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || '", "approved_by": "lead", "candidate_id": ' || o_orderkey
        || ', "candidate_revision": ' || CASE WHEN o_orderkey % 19 > 0 THEN o_orderkey % 3 ELSE 0 END || ', "classification": "' || o_orderstatus || '", "dedup_target_path": ' || CASE WHEN o_orderkey % 2 = 0 THEN '"evolved/' || o_orderkey || '"' ELSE 'null' END
        || ', "question": ' || to_json('say "' || o_orderpriority || '"') || ', "source_version": 1, "value_score": ' || ((o_orderkey % 100) / 100.0)::DOUBLE || '}') AS digest FROM orders""",
    "revalidate_batch_drift": """WITH asked AS (SELECT DISTINCT c_custkey % 45 AS batch_id FROM customer), made AS (SELECT DISTINCT c_custkey % 40 AS batch_id FROM customer),
        v AS (SELECT *, max(o_orderkey % 4) FILTER (WHERE o_orderkey % 23 > 0) OVER (PARTITION BY o_orderstatus, o_custkey) AS newest, o_custkey % 40 AS batch_id FROM orders),
        d AS (SELECT batch_id, o_orderkey AS candidate_id, CASE WHEN o_orderkey % 13 = 0 THEN 'candidate_missing' WHEN o_orderkey % 7 = 0 THEN 'candidate_published' WHEN o_orderkey % 17 = 0 AND batch_id <> 0 THEN 'candidate_publish_queued'
            WHEN o_orderkey % 19 = 0 OR o_orderkey % 5 = 0 THEN 'revision_drift' WHEN o_orderkey % 11 = 0 THEN 'digest_mismatch' WHEN o_orderkey % 23 > 0 AND newest > o_orderkey % 4 THEN 'source_version_drift' END AS reason FROM v)
        SELECT * FROM d WHERE reason IS NOT NULL AND batch_id IN (FROM asked) AND batch_id IN (FROM made) UNION ALL SELECT batch_id, 0, 'batch_missing' FROM asked WHERE batch_id NOT IN (FROM made)""",
}
