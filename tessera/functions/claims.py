"""Claims, citations, reliability, drafts and other rules on single rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The units that make a number a claim, in this order of preference.
CLAIM = r"\d+(?:\.\d+)?\s*(?:元|块钱|天|个工作日|工作日|小时|分钟|秒|个月|月|年|%|％|倍|单|次|件|kg|千米|公里)"
FALLBACK_REPLY = "您咨询的具体数字需要进一步核实，我暂时无法给出准确答复；已为您转人工确认，请稍候。"
CONTEXT_WORDS = ("根据", "依据", "来源", "参考", "政策", "文档")


def joined_thousands(text: Column) -> Column:
    """Without the commas between digits."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?<=\d),(?=\d)", "")


def claims(text: Column) -> Column:
    """Numbers with a unit, without white space and thousands separators."""
    found = F.regexp_extract_all(joined_thousands(text), F.lit(CLAIM), F.lit(0))
    return F.transform(found, lambda c: F.regexp_replace(c, r"\s+", ""))


def grounded(sentence: Column, evidence: Column) -> Column:
    """Whether every claim of the sentence stands in the evidence; true without claims."""
    blob = F.regexp_replace(joined_thousands(evidence), r"\s+", "")
    return F.forall(claims(sentence), lambda c: F.contains(blob, c))


def ground_reply(reply: Column, evidence: Column) -> Column:
    """The reply's grounded sentences; the fallback if none is left; unchanged without evidence."""
    sentences = F.filter(F.split(reply, r"(?<=[。！？!?；;\n])"), lambda s: s != "")
    kept = F.trim(F.array_join(F.filter(sentences, lambda s: grounded(s, evidence)), ""))
    return F.when(F.trim(F.coalesce(evidence, F.lit(""))) == "", reply).when(kept == "", F.lit(FALLBACK_REPLY)).otherwise(kept)


def citations(text: Column) -> Column:
    """Titles in 《》 after a context word, then file names; distinct, in order."""
    context = "|".join(CONTEXT_WORDS)
    books = F.regexp_extract_all(text, F.lit(rf"(?:{context})[^《》]{{0,5}}《([^《》]{{1,80}})》"), F.lit(1))
    files = F.regexp_extract_all(text, F.lit(r"(?i)(?<![A-Za-z0-9_\-./\\])([A-Za-z0-9\x{4e00}-\x{9fff}_\-./\\]+\.(?:md|txt|pdf|docx|doc|html))(?![A-Za-z0-9])"), F.lit(1))
    bare = F.transform(files, lambda f: F.regexp_replace(f, "^(?:请参考|参考|详见|见|来源|根据|依据)+", ""))
    return F.filter(F.array_distinct(F.transform(F.concat(books, bare), lambda c: F.trim(c))), lambda c: c != "")


def normalize_source(name: Column) -> Column:
    """Base name without extension, in lower case."""
    base = F.element_at(F.split(F.regexp_replace(F.trim(name), r"\\", "/"), "/"), -1)
    return F.lower(F.regexp_replace(base, r"(?i)\.(md|txt|pdf|docx|doc|html)$", ""))


def verify_citations(text: Column, sources: Column) -> Column:
    """A struct of cited, matched and missing citations."""
    known, cited = F.transform(sources, normalize_source), citations(text)
    inside = lambda c: F.array_contains(known, normalize_source(c))
    return F.struct(cited.alias("cited"), F.filter(cited, inside).alias("matched"), F.filter(cited, lambda c: ~inside(c)).alias("missing"))


def reliability(tier: Column, tainted: Column, conflict: Column, degraded: Column) -> Column:
    """A tier's score, then the least of the caps that apply."""
    base = F.when(tier == "strong", 0.9).when(tier == "medium", 0.7).when(tier == "weak", 0.5).otherwise(0.3)
    caps = [F.when(tainted, 0.2).otherwise(1.0), F.when(conflict, 0.4).otherwise(1.0), F.when(degraded, 0.6).otherwise(1.0)]
    return F.least(base, *caps)


def draft_expired(created_at: Column, now: Column, ttl_minutes: int) -> Column:
    """Older than its time to live, or without a readable time."""
    at = F.try_to_timestamp(created_at)
    return F.coalesce(at < now - F.expr(f"INTERVAL {ttl_minutes} MINUTES"), F.lit(True))


def valid_identifier(value: Column) -> Column:
    return F.coalesce(value.rlike(r"^[A-Za-z0-9][A-Za-z0-9_.:@\-]{0,127}$"), F.lit(False))


def candidate_id(kind: str, *parts: Column) -> Column:
    """A stable id: SHA-256 of the kind, the version and the parts joined by '|'."""
    return F.sha2(F.concat(F.lit(f"{kind}:v1:"), F.concat_ws("|", *parts)), 256)


def split_fold(key: Column, dev_share: float = 0.8) -> Column:
    """dev or holdout, by the first four hexadecimal digits of the key's SHA-256."""
    return F.when(F.conv(F.substring(F.sha2(key, 256), 1, 4), 16, 10).cast("int") <= int(dev_share * 65535), "dev").otherwise("holdout")


def judge_number(text: Column, low: float, high: float) -> Column:
    """A verdict's number cut to its range; null if it isn't one."""
    value = text.try_cast("double")
    return F.when(value.isNotNull() & ~F.isnan(value), F.least(F.greatest(value, F.lit(low)), F.lit(high)))
