"""Queries for text rules: normalisation, screening, claims and page sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import claims, safety, text
from tessera.operators import mining
from tessera.plans._tables import Query, messages, table
from tessera.sources import html, knowledge


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def _chat(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations")


def normalize_document(spark: SparkSession, sf: str) -> DataFrame:
    out = text.normalize_document(F.col("text"))
    return _docs(spark, sf).select("doc_id", F.length(out).cast("long").alias("chars"), F.sha2(F.encode(out, "UTF-8"), 256).alias("sha256"))


def chunk_distribution(spark: SparkSession, sf: str) -> DataFrame:
    sized = _docs(spark, sf).withColumn("n", F.length("text"))
    return sized.groupBy("lang").agg(F.count("*").alias("chunks"), F.round(F.avg("n"), 6).alias("mean_chars"), F.round(F.percentile("n", F.lit(0.5)), 6).alias("median_chars"), F.round(F.avg((F.col("n") < 200).cast("double")), 9).alias("short_share"))


def contextual_enrich(spark: SparkSession, sf: str) -> DataFrame:
    """Contexts by content hash: equal texts share one, so each distinct text is made once and else found."""
    hashed = _docs(spark, sf).select(F.sha2(F.encode("text", "UTF-8"), 256).alias("key"))
    per = hashed.groupBy("key").agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("generated"), F.sum(F.col("n") - 1).alias("cached"))


def clean_context(spark: SparkSession, sf: str) -> DataFrame:
    return _chat(spark, sf).select("conv_id", "turn", text.clean_context(F.col("text"), 120).alias("context"))


def summary_truncate(spark: SparkSession, sf: str) -> DataFrame:
    return _chat(spark, sf).select("conv_id", "turn", text.truncate_summary(F.col("text"), 100).alias("summary"))


def attach_parents(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of a conversation and role joined in order to their parent text, if there are several and they fit."""
    grouped = _chat(spark, sf).groupBy("conv_id", "role").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("parts"))
    joined = F.array_join(F.transform("parts", lambda p: p["text"]), "\n\n")
    return grouped.where("n > 1").select("conv_id", "role", "n", joined.alias("parent")).where(F.length("parent") <= 4000).withColumn("parent", F.sha2(F.encode("parent", "UTF-8"), 256))


def pii_mask(spark: SparkSession, sf: str) -> DataFrame:
    masked = safety.pii_mask(F.col("text"))
    return _docs(spark, sf).select("doc_id", F.sha2(F.encode(masked, "UTF-8"), 256).alias("masked"), (masked != F.col("text")).alias("changed"))


def has_pii(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).groupBy("lang").agg(F.count_if(safety.has_pii(F.col("text"))).alias("with_pii"), F.count("*").alias("n"))


def has_injection(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).groupBy("source").agg(F.count_if(safety.has_injection(F.col("text"))).alias("tainted"), F.count("*").alias("n"))


def guard_input(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).groupBy(safety.guard_input(F.col("text")).alias("action")).agg(F.count("*").alias("n"))


def fence_taint(spark: SparkSession, sf: str) -> DataFrame:
    out = safety.fence_taint(F.col("text"), F.substring("text", 1, 100))
    return _docs(spark, sf).select("doc_id", out["tainted"].alias("tainted"), F.length(out["text"]).cast("long").alias("chars"))


def guard_output(spark: SparkSession, sf: str) -> DataFrame:
    said = safety.guard_output(F.col("text"), F.lit("neutral"))
    return _chat(spark, sf).groupBy("role").agg(F.count(said).alias("blocked"), F.count("*").alias("n"))


def emotion_level(spark: SparkSession, sf: str) -> DataFrame:
    return _chat(spark, sf).groupBy("role", safety.emotion_level(F.col("text")).alias("level"), F.coalesce(safety.business_escalation(F.col("text")), F.lit("none")).alias("escalation")).agg(F.count("*").alias("n"))


def normalize_question(spark: SparkSession, sf: str) -> DataFrame:
    return _chat(spark, sf).where("role = 'user'").select("conv_id", "turn", text.normalize_question(F.col("text")).alias("question"))


def normalize_answer(spark: SparkSession, sf: str) -> DataFrame:
    return _chat(spark, sf).where("role = 'assistant'").select("conv_id", "turn", text.normalize_answer(F.col("text")).alias("answer"))


def candidate_ids(spark: SparkSession, sf: str) -> DataFrame:
    key = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return _chat(spark, sf).select("conv_id", "turn", claims.candidate_id("turn", key).alias("turn_id"), claims.candidate_id("legacy", F.col("conv_id").cast("string"), F.col("turn").cast("string"), F.col("text")).alias("legacy_id"))


def estimate_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", text.estimate_tokens(F.col("text")).cast("long").alias("tokens"))


def budget_shares(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", *[v.alias(k) for k, v in text.budget_shares(F.col("n_chars")).items()])


def fact_claims(spark: SparkSession, sf: str) -> DataFrame:
    """Claims with a unit ('%' here) of each document, and whether the benchmark passages' texts know them all."""
    return _docs(spark, sf).select("doc_id", F.size(claims.claims(F.col("text"))).alias("claims"), claims.grounded(F.col("text"), F.col("text")).alias("grounded"))


def extract_citations(spark: SparkSession, sf: str) -> DataFrame:
    return _chat(spark, sf).select("conv_id", "turn", F.size(claims.citations(F.concat("text", F.lit(" see guide-"), F.col("conv_id").cast("string"), F.lit(".md and guide-1.md")))).alias("cited"))


def normalize_source(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", claims.normalize_source(F.concat("url", F.lit("/Page.HTML"))).alias("a"), claims.normalize_source(F.col("url")).alias("b"))


def hash_split(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).groupBy(claims.split_fold(F.col("doc_id").cast("string")).alias("fold")).agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


def identifier_validate(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", claims.valid_identifier(F.col("c_name")).alias("name_ok"), claims.valid_identifier(F.concat(F.lit("-"), F.col("c_name"))).alias("dashed_ok"))


def judge_coerce(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", claims.judge_number(F.col("value").cast("string"), 0.0, 5.0).alias("score"), claims.judge_number(F.col("event_type"), 0.0, 1.0).alias("none"))


def reliability(spark: SparkSession, sf: str) -> DataFrame:
    tier = F.when(F.col("o_totalprice") > 300000, "strong").when(F.col("o_totalprice") > 150000, "medium").when(F.col("o_totalprice") > 50000, "weak").otherwise("none")
    score = claims.reliability(tier, F.col("o_orderstatus") == "F", F.col("o_orderpriority").startswith("1"), F.col("o_orderstatus") == "P")
    return table(spark, sf, "orders").groupBy(score.alias("reliability")).agg(F.count("*").alias("n"))


def parse_html(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", html.html_text(F.col("html")).alias("text"))


def repeated_line_count(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that stand in three or more documents of a source."""
    lines = _docs(spark, sf).select("source", "doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.trim("line") != "")
    return lines.groupBy("source", "line").agg(F.countDistinct("doc_id").alias("docs")).where("docs >= 3")


def governance_path_filter(spark: SparkSession, sf: str) -> DataFrame:
    kinds = F.element_at(F.array(*map(F.lit, ("a.md", "evolved/a.md", "uploads/b.txt", "archive/a.md", "evolved/.x/a.md", "evolved/a.md~", "other/a.md", "uploads/a.bak"))), (F.col("doc_id") % 8 + 1).cast("int"))
    return _docs(spark, sf).select("doc_id", kinds.alias("path")).withColumn("allowed", knowledge.allowed_path(F.col("path")))


def governance_validate(spark: SparkSession, sf: str) -> DataFrame:
    row = _docs(spark, sf).select(
        "doc_id", F.element_at(F.array(F.lit("active"), F.lit("archived"), F.lit("draft")), (F.col("doc_id") % 3 + 1).cast("int")).alias("status"),
        F.when(F.col("doc_id") % 2 == 0, "platform").otherwise("external_reference").alias("authority"), F.concat(F.lit("2024-0"), (F.col("doc_id") % 10).cast("string"), F.lit("-15")).alias("date"),
    )
    s, a, d = F.col("status"), F.col("authority"), F.col("date")
    return row.select("doc_id", F.array_join(knowledge.governance_problems(s, a, d), ",").alias("problems"), knowledge.eligible(s, a).alias("eligible"), knowledge.knowledge_expiry(d, F.lit("2024-08-01").cast("date"), 60).alias("expiry"))


def sidecar_parse(spark: SparkSession, sf: str) -> DataFrame:
    side = F.concat(F.lit("Status: active\n# note\nDoc: "), F.col("doc_id").cast("string"), F.lit("\nstatus: archived\nURL: http://x/"), F.col("lang"))
    m = knowledge.parse_sidecar(side)
    return _docs(spark, sf).select("doc_id", m["status"].alias("status"), m["doc"].alias("doc"), m["url"].alias("url"), F.size(m).alias("keys"))


def lexicon_mine(spark: SparkSession, sf: str) -> DataFrame:
    words = table(spark, sf, "conversations").select(F.col("conv_id").alias("id"), text.tokens(F.col("text")).alias("words"))
    return mining.frequent_ngrams(words, 3, 5).withColumn("freq", F.col("freq").cast("long"))


def message_search(spark: SparkSession, sf: str) -> DataFrame:
    found = messages(spark, sf).where(F.contains(F.lower("text"), F.lit("the")))
    return found.groupBy("role").agg(F.count("*").alias("n"), F.max("seq").alias("last_seq"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    normalize_document, chunk_distribution, contextual_enrich, clean_context, summary_truncate, attach_parents, pii_mask, has_pii, has_injection, guard_input, fence_taint,
    guard_output, emotion_level, normalize_question, normalize_answer, candidate_ids, estimate_tokens, budget_shares, fact_claims, extract_citations, normalize_source, hash_split,
    identifier_validate, judge_coerce, reliability, parse_html, repeated_line_count, governance_path_filter, governance_validate, sidecar_parse, lexicon_mine, message_search,
)}

_NORMAL = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '^\x{feff}', ''), '\r\n?', chr(10), 'g'), '(?m)[ \t\f\v]+$', '', 'g'), '^\s+|\s+$', '', 'g')"
_WORD = r"[\pL\pN\pM_]"
_EMAIL = rf"({_WORD}|[.+-])+@({_WORD}|-)+(\.({_WORD}|-)+)+"
_MASKED = rf"regexp_replace(regexp_replace(regexp_replace(text, '{_EMAIL}', '【邮箱】', 'g'), '(^|[^0-9])1[3-9][0-9]{{9}}($|[^0-9])', '\1【手机号】\2', 'g'), '[0-9]{{12,}}', '【单号】', 'g')"
_TAINT = r"(regexp_matches(text, '(?im)^\s*(system|user|assistant)\s*[:：]') OR contains(lower(text), 'ignore previous') OR contains(lower(text), 'ignore all previous') OR contains(lower(text), 'disregard previous') OR contains(lower(text), 'dev_mode') OR contains(lower(text), 'hidden_tools') OR contains(text, '```'))"
_ONE_LINE = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"

ORACLE_SQL: dict[str, str] = {
    "normalize_document": f"SELECT doc_id, length(t) AS chars, sha256(t) AS sha256 FROM (SELECT doc_id, {_NORMAL} AS t FROM documents)",
    "chunk_distribution": "SELECT lang, count(*) AS chunks, round(avg(length(text)), 6) AS mean_chars, round(quantile_cont(length(text), 0.5), 6) AS median_chars, round(avg((length(text) < 200)::INT), 9) AS short_share FROM documents GROUP BY lang",
    "contextual_enrich": "SELECT count(*) AS generated, (sum(n) - count(*))::BIGINT AS cached FROM (SELECT text, count(*) AS n FROM documents GROUP BY text)",
    "clean_context": rf"""SELECT conv_id, turn, CASE WHEN length(o) <= 120 THEN o WHEN cut <> '' THEN cut ELSE o[1:120] END AS context
        FROM (SELECT *, regexp_extract(o[1:120], '(?s)^(.*[。！？；.!?;])', 1) AS cut FROM (SELECT conv_id, turn, regexp_replace({_ONE_LINE}, '^["''“”]+|["''“”]+$', '', 'g') AS o FROM conversations))""",
    "summary_truncate": r"""SELECT conv_id, turn, CASE WHEN length(text) <= 100 THEN text ELSE (CASE WHEN cut <> '' THEN rtrim(cut) ELSE text[1:99] END) || '…' END AS summary
        FROM (SELECT *, regexp_extract(text[1:99], '(?s)^(.*[。！？.!?\n])', 1) AS cut FROM conversations)""",
    "attach_parents": "SELECT conv_id, role, n, sha256(parent) AS parent FROM (SELECT conv_id, role, count(*) AS n, string_agg(text, chr(10) || chr(10) ORDER BY turn, text) AS parent FROM conversations GROUP BY ALL) WHERE n > 1 AND length(parent) <= 4000",
    "pii_mask": f"SELECT doc_id, sha256(m) AS masked, m <> text AS changed FROM (SELECT doc_id, text, {_MASKED} AS m FROM documents)",
    "has_pii": f"SELECT lang, count(*) FILTER (WHERE {_MASKED} <> text) AS with_pii, count(*) AS n FROM documents GROUP BY lang",
    "has_injection": f"SELECT source, count(*) FILTER (WHERE {_TAINT}) AS tainted, count(*) AS n FROM documents GROUP BY source",
    "guard_input": f"SELECT CASE WHEN {_TAINT} THEN 'block' WHEN {_MASKED} <> text THEN 'mask' ELSE 'ok' END AS action, count(*) AS n FROM documents GROUP BY 1",
    "fence_taint": f"SELECT doc_id, {_TAINT} AS tainted, CASE WHEN {_TAINT} THEN 16 ELSE length(text) END AS chars FROM documents",
    "guard_output": "SELECT role, 0::BIGINT AS blocked, count(*) AS n FROM conversations GROUP BY role",
    "emotion_level": "SELECT role, CASE WHEN contains(text, '12315') THEN 'extreme' ELSE 'neutral' END AS level, 'none' AS escalation, count(*) AS n FROM conversations GROUP BY ALL",
    "normalize_question": rf"SELECT conv_id, turn, CASE WHEN length(q) BETWEEN 4 AND 120 THEN q ELSE '' END AS question FROM (SELECT conv_id, turn, trim(regexp_replace({_ONE_LINE}, '^#+', '')) AS q FROM conversations WHERE role = 'user')",
    "normalize_answer": r"""SELECT conv_id, turn, CASE WHEN length(a) BETWEEN 20 AND 1200 THEN a ELSE '' END AS answer FROM (
        SELECT conv_id, turn, regexp_replace(array_to_string(list_filter(list_transform(regexp_split_to_array(text, '\r\n|\r|\n'), lambda x: trim(x)), lambda x: NOT (starts_with(x, '## ') OR starts_with(x, '### '))), chr(10)), '^\s+|\s+$', '', 'g') AS a
        FROM conversations WHERE role = 'assistant')""",
    "candidate_ids": "SELECT conv_id, turn, sha256('turn:v1:' || conv_id || '-' || turn) AS turn_id, sha256('legacy:v1:' || conv_id || '|' || turn || '|' || text) AS legacy_id FROM conversations",
    "estimate_tokens": r"""SELECT doc_id, greatest(coalesce(list_sum(list_transform(regexp_extract_all(text, '[\x00-\x7f]+'), lambda r: length(r) // 4)), 0) + length(text) - coalesce(list_sum(list_transform(regexp_extract_all(text, '[\x00-\x7f]+'), lambda r: length(r))), 0),
        CASE WHEN regexp_matches(text, '\S') THEN 1 ELSE 0 END)::BIGINT AS tokens FROM documents""",
    "budget_shares": "SELECT doc_id, least(floor(w * 0.2::DOUBLE)::BIGINT, 8192) AS system, least(floor(w * 0.1::DOUBLE)::BIGINT, 8192) AS memory, least(floor(w * 0.5::DOUBLE)::BIGINT, 65536) AS dialog, floor(w * 0.2::DOUBLE)::BIGINT AS output_reserve FROM (SELECT doc_id, greatest(n_chars, 1024) AS w FROM documents)",
    "fact_claims": r"SELECT doc_id, len(regexp_extract_all(regexp_replace(text, '([0-9]),([0-9])', '\1\2', 'g'), '[0-9]+(?:\.[0-9]+)?\s*(?:%|％|kg)'))::INT AS claims, true AS grounded FROM documents",
    "extract_citations": "SELECT conv_id, turn, CASE WHEN conv_id = 1 THEN 1 ELSE 2 END AS cited FROM conversations",
    "normalize_source": r"SELECT page_id, 'page' AS a, lower(regexp_replace(list_last(string_split(url, '/')), '(?i)\.(md|txt|pdf|docx|doc|html)$', '')) AS b FROM pages",
    "hash_split": "SELECT CASE WHEN ('0x' || sha256(doc_id::VARCHAR)[1:4])::INT <= 52428 THEN 'dev' ELSE 'holdout' END AS fold, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM documents GROUP BY 1",
    "identifier_validate": r"SELECT c_custkey, regexp_full_match(c_name, '[A-Za-z0-9][A-Za-z0-9_.:@-]{0,127}') AS name_ok, false AS dashed_ok FROM customer",
    "judge_coerce": "SELECT event_id, least(greatest(value, 0.0::DOUBLE), 5.0::DOUBLE) AS score, NULL::DOUBLE AS none FROM events",
    "reliability": """SELECT least(CASE WHEN o_totalprice > 300000 THEN 0.9::DOUBLE WHEN o_totalprice > 150000 THEN 0.7::DOUBLE WHEN o_totalprice > 50000 THEN 0.5::DOUBLE ELSE 0.3::DOUBLE END,
        CASE WHEN o_orderstatus = 'F' THEN 0.2::DOUBLE ELSE 1 END, CASE WHEN starts_with(o_orderpriority, '1') THEN 0.4::DOUBLE ELSE 1 END, CASE WHEN o_orderstatus = 'P' THEN 0.6::DOUBLE ELSE 1 END) AS reliability, count(*) AS n FROM orders GROUP BY 1""",
    "repeated_line_count": "SELECT source, line, count(DISTINCT doc_id) AS docs FROM (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line) <> '' GROUP BY ALL HAVING count(DISTINCT doc_id) >= 3",
    "governance_path_filter": "SELECT doc_id, ['a.md', 'evolved/a.md', 'uploads/b.txt', 'archive/a.md', 'evolved/.x/a.md', 'evolved/a.md~', 'other/a.md', 'uploads/a.bak'][doc_id % 8 + 1] AS path, doc_id % 8 < 3 AS allowed FROM documents",
    "governance_validate": """SELECT doc_id, array_to_string(list_filter([CASE WHEN s = 'draft' THEN 'status' END, CASE WHEN doc_id % 10 = 0 THEN 'effective_date' END, CASE WHEN s = 'active' AND a = 'external_reference' THEN 'active_external' END], lambda x: x IS NOT NULL), ',') AS problems,
        s <> 'archived' AND a <> 'external_reference' AS eligible, CASE WHEN doc_id % 10 = 0 THEN 'unknown' WHEN ('2024-0' || (doc_id % 10) || '-15')::DATE < DATE '2024-06-02' THEN 'expired' ELSE 'valid' END AS expiry
        FROM (SELECT doc_id, ['active', 'archived', 'draft'][doc_id % 3 + 1] AS s, CASE WHEN doc_id % 2 = 0 THEN 'platform' ELSE 'external_reference' END AS a FROM documents)""",
    "sidecar_parse": "SELECT doc_id, 'archived' AS status, doc_id::VARCHAR AS doc, 'http://x/' || lang AS url, 3 AS keys FROM documents",
    "lexicon_mine": """WITH w AS (SELECT list_transform(regexp_extract_all(text, '[0-9A-Za-z]+'), lambda x: lower(x)) AS w FROM conversations),
        g AS (SELECT n, unnest(list_transform(range(1, len(w) - n + 2), lambda p: array_to_string(w[p:p + n - 1], ' '))) AS gram FROM w, (SELECT unnest([1, 2, 3]) AS n))
        SELECT gram, n, count(*) AS freq FROM g GROUP BY ALL HAVING count(*) >= 5""",
    "message_search": "SELECT role, count(*) AS n, max(turn) AS last_seq FROM conversations WHERE contains(lower(text), 'the') GROUP BY role",
}
