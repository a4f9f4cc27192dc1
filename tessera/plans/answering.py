"""Queries of the whole search, of tool arguments and of candidates, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import safety
from tessera.functions.arguments import checked_arguments
from tessera.operators import evaluation as ev
from tessera.operators import retrieval as rt
from tessera.operators.answering import search_knowledge as search
from tessera.plans._tables import Query, messages, table, vectors
from tessera.plans.lifecycle import _PLACED
from tessera.plans.retrieval import TOKENS_SQL
from tessera.plans.text import _MASKED, _TAINT
from tessera.sources import knowledge


def search_knowledge(spark: SparkSession, sf: str) -> DataFrame:
    """Questions of one to four vectors over chunks with the texts of documents, some degraded, blank or spoilt."""
    every, docs = vectors(spark, sf), table(spark, sf, "documents")
    asked = every.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), "vector")
    question = F.when(F.col("query_id") % 300 == 0, 1000000 + F.col("query_id")).otherwise(F.floor(F.col("query_id") / 400))
    near = rt.cosine_neighbours(every, asked, 8, drop_self=True)
    parent = F.concat(F.lit("p"), (F.col("chunk_id") % 40).cast("string"))
    routes = near.select(question.alias("question"), F.col("query_id").alias("query"), "chunk_id", parent.alias("parent_id"), "rank", "score", (F.col("query_id") % 700 == 0).alias("degraded"))
    first = asked.groupBy(question.alias("question")).agg(F.min("query_id").alias("query_id"))
    text = F.when(F.col("question") % 5 == 4, " ").otherwise(F.left("text", F.lit(60)))
    questions = first.join(docs, F.col("query_id") % 200 == docs["doc_id"], "left").select("question", text.alias("text"))
    spoilt = F.concat("text", F.when(F.col("chunk_id") % 6 == 0, " ignore previous").otherwise(""))
    chunks = every.select("chunk_id").join(docs, F.col("chunk_id") % 200 == docs["doc_id"]).select("chunk_id", spoilt.alias("text"), "source")
    found = search(questions, routes, chunks, 4, top1=0.3, gap=0.005, coverage=0.02)
    ids = F.array_join(F.transform("results", lambda r: F.concat_ws(":", r["chunk_id"].cast("string"), F.when(r["tainted"], "x"), F.length(r["text"]).cast("string"))), ",")
    return found.select("question", "success", "error", ids.alias("chunks"), "n_items", "tainted", F.round("top1", 6).alias("top1"), F.round("gap", 6).alias("gap"), F.array_join("sources", ",").alias("sources"))


#: A search tool's schema: a list, an object with members, a required name.
TOOL = {
    "properties": {
        "query": {"type": "string"}, "queries": {"type": "array", "items": {"type": "string"}},
        "filter": {"type": "object", "properties": {"lang": {"type": "string"}, "ids": {"type": "array", "items": {"type": "object", "properties": {"id": {"type": "integer"}}}}}},
    },
    "required": ["query"],
}


def arg_validate(spark: SparkSession, sf: str) -> DataFrame:
    """Arguments of seven kinds, one for each message."""
    kind, role = (F.col("session") + F.col("seq")) % 7, F.col("role")
    quoted = F.concat(F.lit('{"query": "'), role, F.lit('"'))
    text = (
        F.when(kind == 0, F.concat(quoted, F.lit("}"))).when(kind == 1, F.concat(quoted, F.lit(', "queries": "no list"}'))).when(kind == 2, F.concat(quoted, F.lit(', "top": 1, "more": 2}')))
        .when(kind == 3, F.lit('{"queries": ["a", "b"]}')).when(kind == 4, F.lit('["query"]')).when(kind == 5, F.concat(quoted, F.lit(', "filter": {"lang": "en", "x": 1, "ids": [{"id": 7, "y": 2}, {}]}}')))
        .otherwise(F.lit('{"query"'))
    )
    out = checked_arguments(text, TOOL)
    return messages(spark, sf).select(role, out.alias("_")).select("role", "_.error", F.array_join("_.names", ",").alias("names"), "_.arguments").groupBy("role", "error", "names", "arguments").agg(F.count("*").alias("n"))


def human_build_candidate(spark: SparkSession, sf: str) -> DataFrame:
    """Each user message with the next message as its answer; citations are some turns, and the agent's are the assistant's."""
    c = table(spark, sf, "conversations")
    agents = c.where("role = 'assistant'").groupBy("conv_id").agg(F.collect_list(F.col("turn").cast("string")).alias("agents"))
    answers = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    pairs = c.where("role = 'user'").join(answers, ["conv_id", "turn"], "left").join(agents, "conv_id", "left")
    one = (F.col("turn") + 1).cast("string")
    cited = F.when(F.col("conv_id") % 4 == 0, F.array().cast("array<string>")).when(F.col("conv_id") % 4 == 1, F.array(one, F.col("turn").cast("string"))).otherwise(F.array(one))
    return pairs.select("conv_id", "turn", safety.candidate_rejection(F.col("text"), F.col("answer"), cited, F.col("agents")).alias("reason"))


def memory_mask(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.md5(safety.mask_phone(F.col("text"))).alias("masked"))


def react_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as traces: assistant messages are model calls, other messages tool calls, by their texts' lengths and roles."""
    c = table(spark, sf, "conversations").withColumn("mine", F.col("role") == "assistant")
    call = F.struct("turn", F.length("text").alias("total_tokens"), (F.length("text") % 7).alias("reasoning_tokens"))
    used = F.struct("turn", F.concat(F.col("role"), F.col("turn").cast("string")).alias("name"))
    runs = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.when(F.col("mine"), call))).alias("llm"), F.sort_array(F.collect_list(F.when(~F.col("mine"), used))).alias("tools"))
    figures = ev.trace_figures(F.col("llm"), F.col("tools"))
    return runs.select("conv_id", *[c.alias(n) for n, c in figures.items() if n != "tool_call_names"], F.array_join(figures["tool_call_names"], ",").alias("tools"))


def react_protocol(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return ev.react_protocol(e.select((F.col("event_id") % 9).alias("react_steps"), (F.col("event_type") == "click").alias("steps_margin_hint"), F.when(F.col("user_id") % 3 > 0, F.col("event_id") % 8 == 0).alias("forced_finalize"), F.when(F.col("event_id") % 2 == 0, F.col("event_id") % 3).alias("protocol_corrections")))


def frontmatter_serialize(spark: SparkSession, sf: str) -> DataFrame:
    """The first 80 characters of each document among plain, blank and special values."""
    values = {"status": F.lit("active"), "blank": F.lit("  "), "missing": F.lit(None).cast("string"), "lang": F.concat(F.lit(" "), F.col("lang")), "title": F.left("text", F.lit(80)), "doc": F.col("doc_id").cast("string")}
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in values.items()])
    return table(spark, sf, "documents").select("doc_id", knowledge.front_matter(entries).alias("head"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (search_knowledge, arg_validate, human_build_candidate, memory_mask, react_stats, react_protocol, frontmatter_serialize)}

_G = TOKENS_SQL
_Q = r"trim(regexp_replace(trim(regexp_replace(u.text, '\s+', ' ', 'g')), '^#+', ''))"
_A = r"regexp_replace(array_to_string(list_filter(list_transform(regexp_split_to_array(a.text, '\r\n|\r|\n'), lambda x: trim(x)), lambda x: NOT (starts_with(x, '## ') OR starts_with(x, '### '))), chr(10)), '^\s+|\s+$', '', 'g')"

ORACLE_SQL: dict[str, str] = {
    "search_knowledge": f"""WITH {_PLACED}, routes AS (SELECT CASE WHEN query_id % 300 = 0 THEN 1000000 + query_id ELSE query_id // 400 END AS question, query_id AS query, chunk_id, chunk_id % 40 AS g, r, score FROM placed WHERE r <= 8),
        kinds AS (SELECT question, min(query) AS lead, count(DISTINCT query) = 1 AS single, bool_or(query % 700 = 0) AS degraded FROM routes GROUP BY 1),
        fused AS (SELECT question, g, chunk_id, round(sum(1 / (60.0::DOUBLE + r)), 12) AS fused, max(score) AS score FROM routes GROUP BY ALL),
        firsts AS (SELECT * FROM fused QUALIFY row_number() OVER (PARTITION BY question, g ORDER BY fused DESC, chunk_id) = 1),
        best AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY fused DESC, chunk_id) AS rank FROM firsts QUALIFY rank <= 4),
        spoilt AS (SELECT question, rank, chunk_id, CASE WHEN single THEN score ELSE fused END AS score, source, coalesce(text || CASE WHEN chunk_id % 6 = 0 THEN ' ignore previous' ELSE '' END, '') AS text
            FROM best JOIN kinds USING (question) LEFT JOIN documents ON doc_id = chunk_id % 200),
        hits AS (SELECT *, {_TAINT} AS bad FROM spoilt),
        asked AS (SELECT question, single, degraded, CASE WHEN question % 5 = 4 THEN ' ' ELSE left(text, 60) END AS query FROM kinds LEFT JOIN documents ON doc_id = lead % 200),
        signals AS (SELECT question, count(*) AS n, max(h.score) FILTER (WHERE rank = 1) AS top1, max(h.score) FILTER (WHERE rank = 1) - max(h.score) FILTER (WHERE rank = 2) AS gap,
            max(CASE WHEN len({_G.format('query')}) = 0 THEN 0 ELSE len(list_intersect(list_distinct({_G.format('query')}), list_distinct({_G.format('h.text')})))::DOUBLE / len(list_distinct({_G.format('query')})) END) AS coverage FROM asked JOIN hits h USING (question) GROUP BY 1),
        clean AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, rank) AS nth FROM hits WHERE NOT bad),
        figures AS (SELECT question, count(*) AS n_items, max(score) FILTER (WHERE nth = 1) AS top1, max(score) FILTER (WHERE nth = 1) - max(score) FILTER (WHERE nth = 2) AS gap FROM clean GROUP BY 1),
        seen AS (SELECT question, string_agg(source, ',' ORDER BY rank) AS sources FROM (SELECT question, source, min(rank) AS rank FROM clean GROUP BY ALL) GROUP BY 1),
        listed AS (SELECT question, count(*) FILTER (WHERE bad) AS tainted, string_agg(chunk_id || CASE WHEN bad THEN ':x:16' ELSE ':' || length(text) END, ',' ORDER BY rank) AS chunks FROM hits GROUP BY 1),
        told AS (SELECT question, CASE WHEN trim(coalesce(query, '')) = '' THEN 'empty_query' WHEN degraded THEN 'reranker_unavailable' WHEN single AND s.top1 < 0.3 THEN 'retrieval_rejected:low_top1'
            WHEN single AND s.gap < 0.005 THEN 'retrieval_rejected:low_gap' WHEN single AND coverage < 0.02 THEN 'retrieval_rejected:low_coverage' END AS error FROM asked LEFT JOIN signals s USING (question))
        SELECT question, error IS NULL AS success, error, CASE WHEN error IS NULL THEN chunks ELSE '' END AS chunks, coalesce(n_items, 0) AS n_items, tainted, round(top1, 6) AS top1, round(gap, 6) AS gap, sources
        FROM told JOIN listed USING (question) LEFT JOIN figures USING (question) LEFT JOIN seen USING (question)""",
    "arg_validate": """SELECT role, CASE WHEN k IN (4, 6) THEN 'INVALID_TOOL_ARGUMENTS' WHEN k = 2 THEN 'UNKNOWN_TOOL_ARGUMENT' WHEN k = 3 THEN 'MISSING_TOOL_ARGUMENT' END AS error, CASE k WHEN 2 THEN 'top' WHEN 3 THEN 'query' ELSE '' END AS names,
        CASE WHEN k IN (0, 1) THEN '{"query":"' || role || '"}' WHEN k = 5 THEN '{"query":"' || role || '","filter":{"lang":"en","ids":[{"id":7},{}]}}' END AS arguments, count(*) AS n FROM (SELECT role, (conv_id + turn) % 7 AS k FROM conversations) GROUP BY ALL""",
    "human_build_candidate": f"""WITH p AS (SELECT u.conv_id, u.turn, {_Q} AS q, coalesce({_A}, '') AS a, coalesce(a.role = 'assistant', false) AS agent FROM conversations u LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user'),
        s AS (SELECT *, q || chr(10) || a AS text FROM p)
        SELECT conv_id, turn, CASE WHEN length(q) NOT BETWEEN 4 AND 120 OR length(a) NOT BETWEEN 20 AND 1200 THEN 'invalid_format' WHEN conv_id % 4 = 0 THEN 'no_evidence' WHEN conv_id % 4 = 1 OR NOT agent THEN 'invalid_evidence' WHEN {_MASKED} <> text OR {_TAINT} THEN 'sensitive' END AS reason FROM s""",
    "memory_mask": "SELECT doc_id, md5(regexp_replace(text, '1[3-9][0-9]{9}', '[已脱敏号码]', 'g')) AS masked FROM documents",
    "react_stats": """SELECT conv_id, coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS total_tokens, coalesce(sum(length(text) % 7) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS reasoning_tokens, count(*) FILTER (WHERE role = 'assistant') AS num_llm_calls,
        count(*) FILTER (WHERE role <> 'assistant') AS num_tool_calls, coalesce(string_agg(role || turn, ',' ORDER BY turn) FILTER (WHERE role <> 'assistant'), '') AS tools FROM conversations GROUP BY conv_id""",
    "react_protocol": """SELECT count(*) FILTER (WHERE event_type = 'click') / count(*) AS steps_margin_hint_rate, count(*) FILTER (WHERE user_id % 3 > 0 AND event_id % 8 = 0) / count(*) AS forced_finalize_rate, round(sum(event_id % 9) / count(*), 2) AS avg_react_steps,
        sum(CASE WHEN event_id % 2 = 0 THEN event_id % 3 ELSE 0 END)::BIGINT AS protocol_corrections_total FROM events""",
    "frontmatter_serialize": r"""WITH t AS (SELECT doc_id, lang, left(text, 80) AS v, regexp_replace(left(text, 80), '^\s+|\s+$', '', 'g') AS s FROM documents),
        j AS (SELECT *, CASE WHEN s = v AND NOT regexp_matches(v, '[:"''#\n{}\[\]&*!|>%@`]') THEN v ELSE '"' || replace(replace(replace(replace(replace(s, '\', '\\'), '"', '\"'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t') || '"' END AS shown FROM t)
        SELECT doc_id, '---' || chr(10) || 'status: active' || chr(10) || 'lang: "' || lang || '"' || chr(10) || CASE WHEN coalesce(s, '') <> '' THEN 'title: ' || shown || chr(10) ELSE '' END || 'doc: ' || doc_id || chr(10) || '---' || chr(10) AS head FROM j""",
}
