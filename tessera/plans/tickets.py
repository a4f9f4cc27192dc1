"""Queries of handoff tickets and checked cases, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import handoffs
from tessera.plans._tables import Query, table
from tessera.sources import cases


def _events(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's events as those of a few tickets: sign-ups create, clicks claim, purchases resolve, the rest are notes."""
    e = table(spark, sf, "events")
    action = F.when(F.col("event_type") == "signup", "create").when(F.col("event_type") == "click", "claim").when(F.col("event_type") == "purchase", "resolve").otherwise("note")
    ticket = F.col("user_id") * 10 + F.col("event_id") % 3
    return e.select("event_id", F.col("event_id").alias("seq"), ticket.alias("ticket_id"), action.alias("action"), F.concat(F.lit("agent-"), F.col("event_id") % 2).alias("actor"), (F.floor("value") % 2).cast("string").alias("resolution"))


def handoff_claim(spark: SparkSession, sf: str) -> DataFrame:
    return handoffs.handoff_verdicts(_events(spark, sf))


def handoff_claim_first(spark: SparkSession, sf: str) -> DataFrame:
    return handoffs.handoff_verdicts(_events(spark, sf), claim_first=True).groupBy("action", "verdict").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


def handoff_resolve(spark: SparkSession, sf: str) -> DataFrame:
    return handoffs.handoff_tickets(_events(spark, sf)).select("ticket_id", "status", "assignee", "resolved_by")


def scan_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark passages as cases of seven files, some of them spoilt."""
    b, i = table(spark, sf, "benchmark"), F.col("item_id")
    quoted = lambda c: F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    ident = F.when(i % 11 == 3, quoted(F.lit("same"))).when(i % 11 == 4, i.cast("string")).otherwise(quoted(F.concat(F.lit("c"), i)))
    query = F.when(i % 13 == 5, F.lit('"  "')).otherwise(quoted(F.concat(F.lit(" "), F.col("text"))))
    expected = F.when(i % 17 == 6, F.lit('["a","a"]')).when(i % 17 == 7, F.lit('["a",1]')).otherwise(F.lit('["a","b"]'))
    k = F.when(i % 19 == 8, F.lit(',"k":0')).when(i % 19 == 9, F.lit(',"k":true')).when(i % 19 == 10, F.lit(',"k":3')).otherwise("")
    tags = F.when(i % 23 == 9, F.lit(',"tags":[" "]')).otherwise(F.lit(',"tags":["t"]'))
    case = F.when(i % 29 == 1, F.lit("7")).when(i % 29 == 2, F.concat(F.lit('{"id":'), ident, F.lit(',"query":'), query, F.lit("}"))).otherwise(F.concat(F.lit('{"id":'), ident, F.lit(',"query":'), query, F.lit(',"expected":'), expected, k, tags, F.lit("}")))
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("item_id", case.alias("case")))), lambda x: x["case"]), ",")
    files = b.groupBy((i % 7).cast("string").alias("path")).agg(F.concat(F.lit('{"cases":['), listed, F.lit("]}")).alias("content"))
    return cases.check_cases(files).select("path", "place", "id", F.size("expected").alias("n_expected"), "k", "error")


QUERIES: dict[str, Query] = {f.__name__: f for f in (handoff_claim, handoff_claim_first, handoff_resolve, scan_cases)}


def _handoff(claim_first: bool) -> str:
    claimed = "(SELECT min(c.seq) FROM e c WHERE c.ticket_id = b.ticket_id AND c.action = 'claim' AND c.seq > b.born)"
    solved = f"(SELECT min(r.seq) FROM e r WHERE r.ticket_id = b.ticket_id AND r.action = 'resolve' AND r.seq > {'b.claim' if claim_first else 'b.born'})"
    return f"""
WITH e AS (
    SELECT event_id, event_id AS seq, user_id * 10 + event_id % 3 AS ticket_id, 'agent-' || (event_id % 2) AS actor, (floor(value) % 2)::BIGINT AS content,
           CASE event_type WHEN 'signup' THEN 'create' WHEN 'click' THEN 'claim' WHEN 'purchase' THEN 'resolve' ELSE 'note' END AS action FROM events
), born AS (
    SELECT ticket_id, min(seq) AS born FROM e WHERE action = 'create' GROUP BY ticket_id
), claims AS (
    SELECT *, {claimed} AS claim FROM born b
), marks AS (
    SELECT *, {solved} AS solved FROM claims b
), held AS (
    SELECT m.ticket_id, born, CASE WHEN solved IS NULL OR claim < solved THEN claim END AS claim, solved, c.actor AS claimer, s.actor AS solver, s.content AS solution
    FROM marks m LEFT JOIN e c ON c.event_id = m.claim AND (m.solved IS NULL OR m.claim < m.solved) LEFT JOIN e s ON s.event_id = m.solved
), verdicts AS (
    SELECT e.event_id, e.ticket_id, e.action,
           CASE WHEN born IS NULL OR seq < born THEN 'not_found' WHEN seq = born THEN 'created' WHEN action = 'create' THEN 'repeated' WHEN action = 'note' THEN 'noted'
                WHEN action = 'claim' THEN CASE WHEN seq = claim THEN 'claimed' WHEN seq > solved THEN 'conflict' WHEN claimer = actor THEN 'repeated' ELSE 'conflict' END
                WHEN seq = solved THEN 'resolved' WHEN seq > solved THEN CASE WHEN content = solution THEN 'repeated' ELSE 'conflict' END ELSE 'refused' END AS verdict
    FROM e LEFT JOIN held ON e.ticket_id = held.ticket_id
)"""


ORACLE_SQL: dict[str, str] = {
    "handoff_claim": f"{_handoff(False)} SELECT * FROM verdicts",
    "handoff_claim_first": f"{_handoff(True)} SELECT action, verdict, count(*) AS n, sum(event_id)::BIGINT AS ids FROM verdicts GROUP BY ALL",
    "handoff_resolve": f"""{_handoff(False)}
SELECT ticket_id, CASE WHEN solved IS NOT NULL THEN 'resolved' WHEN claim IS NOT NULL THEN 'claimed' ELSE 'pending' END AS status, coalesce(claimer, solver) AS assignee, solver AS resolved_by FROM held""",
    "scan_cases": """
WITH c AS (
    SELECT (item_id % 7)::VARCHAR AS path, (row_number() OVER (PARTITION BY item_id % 7 ORDER BY item_id) - 1)::INT AS place, item_id AS i,
           CASE WHEN item_id % 11 = 3 THEN 'same' WHEN item_id % 11 <> 4 THEN 'c' || item_id END AS id, CASE WHEN item_id % 13 <> 5 THEN trim(text) END AS query,
           item_id % 29 = 1 AS plain, item_id % 29 = 2 AS short FROM benchmark
), firsts AS (
    SELECT *, row_number() OVER (PARTITION BY plain OR short, id ORDER BY path, place) AS nth_id, row_number() OVER (PARTITION BY plain OR short, query ORDER BY path, place) AS nth_query FROM c
)
SELECT path, place, CASE WHEN NOT plain THEN id END AS id, CASE WHEN plain OR short OR i % 17 = 7 THEN NULL ELSE 2 END AS n_expected,
       CASE WHEN plain OR short THEN 5 WHEN i % 19 = 8 THEN 0 WHEN i % 19 = 9 THEN NULL WHEN i % 19 = 10 THEN 3 ELSE 5 END AS k,
       CASE WHEN plain THEN 'not_object' WHEN short THEN 'missing_field' WHEN id IS NULL THEN 'bad_id' WHEN nth_id > 1 THEN 'duplicate_id' WHEN query IS NULL THEN 'bad_query' WHEN nth_query > 1 THEN 'duplicate_query'
            WHEN i % 17 = 7 THEN 'bad_expected' WHEN i % 17 = 6 THEN 'duplicate_expected' WHEN i % 19 IN (8, 9) THEN 'bad_k' WHEN i % 23 = 9 THEN 'bad_tags' END AS error
FROM firsts""",
}
