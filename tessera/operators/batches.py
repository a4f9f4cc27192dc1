"""Batches to be published: a digest of what was approved, and why an item has drifted since."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a digest of an approval covers.
APPROVED = ("candidate_id", "candidate_revision", "source_version", "question", "answer", "value_score", "classification", "dedup_target_path", "approved_by", "approved_at")
#: Short forms of control characters in JSON.
_SHORT = {"\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}


def json_text(value: Column) -> Column:
    """A string as JSON: quotes, backslashes and control characters escaped (in lower-case hexadecimal), all else as it is; null as null."""
    out = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for code in range(32):
        out = F.replace(out, F.lit(chr(code)), F.lit(_SHORT.get(chr(code), f"\\u{code:04x}")))
    return F.coalesce(F.concat(F.lit('"'), out, F.lit('"')), F.lit("null"))


def json_double(value: Column) -> Column:
    """A double as JSON: the shortest digits, with an exponent below 1e-4 and from 1e16; null as null."""
    size, plain = F.abs(value), F.regexp_replace(value.cast("decimal(38,21)").cast("string"), "0+$", "")
    digits, power = F.split(value.cast("string"), "E")[0], F.split(value.cast("string"), "E")[1]
    power = F.concat(F.when(power.startswith("-"), "-").otherwise("+"), F.when(F.length(F.replace(power, F.lit("-"))) < 2, "0").otherwise(""), F.replace(power, F.lit("-")))
    wide = F.concat(F.regexp_replace(digits, r"\.0$", ""), F.lit("e"), power)
    whole = F.concat(plain, F.when(plain.endswith("."), "0").otherwise(""))
    shown = F.when(F.isnan(value) | (value == 0) | (size == float("inf")), value.cast("string")).when((size >= 1e-4) & (size < 1e16), whole).otherwise(wide)
    return F.coalesce(shown, F.lit("null"))


def canonical_json(fields: dict[str, Column]) -> Column:
    """An object of ready JSON values with its keys in order, ', ' and ': ' between."""
    parts = [F.concat(F.lit(f'"{name}": '), fields[name]) for name in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def approval_digest(item: str = "") -> Column:
    """SHA-256 of the canonical JSON of the APPROVED columns (``item`` is a prefix such as 'i.'): missing numbers are 0, a missing time is empty."""
    col = lambda name: F.col(item + name)
    numbers = {n: F.coalesce(col(n).cast("long"), F.lit(0)).cast("string") for n in APPROVED[:3]}
    texts = {n: json_text(col(n)) for n in ("question", "answer", "classification", "dedup_target_path", "approved_by")}
    at = json_text(F.coalesce(F.date_format(col("approved_at"), "yyyy-MM-dd HH:mm:ss"), F.lit("")))
    return F.sha2(F.encode(canonical_json({**numbers, **texts, "value_score": json_double(col("value_score").cast("double")), "approved_at": at}), "UTF-8"), 256)


def batch_drift(asked: DataFrame, batches: DataFrame, items: DataFrame, candidates: DataFrame, conversations: DataFrame) -> DataFrame:
    """(batch_id, candidate_id, reason): what keeps the asked batches (batch_id) from being activated; none if all is as approved.

    batches (batch_id); items (batch_id, the APPROVED columns, approval_digest); candidates (id, status, publish_batch_id, revision, conversation_id);
    conversations (id, source, external_conversation_id, source_version). The first reason counts: a missing batch (candidate 0), a
    missing candidate, a status or batch other than queued here, another revision, another digest, a newer version of the conversation.
    A candidate whose conversation is gone has no newer version.
    """
    latest = conversations.groupBy("source", "external_conversation_id").agg(F.max("source_version").alias("_latest"))
    stale = conversations.join(latest, ["source", "external_conversation_id"]).where("_latest > source_version").select(F.col("id").alias("_stale"))
    found = candidates.select(F.col("id").alias("_id"), "status", F.coalesce("publish_batch_id", F.lit(0)).alias("_batch"), F.coalesce("revision", F.lit(0)).alias("_revision"), F.coalesce("conversation_id", F.lit(0)).alias("_conversation"))
    held = items.join(asked.distinct(), "batch_id", "left_semi").join(batches, "batch_id", "left_semi")
    held = held.join(found, held["candidate_id"] == found["_id"], "left").join(stale, F.col("_conversation") == F.col("_stale"), "left")
    elsewhere = ~F.coalesce((F.col("status") == "publish_queued") & (F.col("_batch") == F.col("batch_id")), F.lit(False))
    reason = (
        F.when(F.col("_id").isNull(), "candidate_missing").when(elsewhere, F.concat(F.lit("candidate_"), F.coalesce("status", F.lit(""))))
        .when(F.col("_revision") != F.coalesce("candidate_revision", F.lit(-1)), "revision_drift").when(approval_digest() != F.coalesce("approval_digest", F.lit("")), "digest_mismatch")
        .when(F.col("_stale").isNotNull(), "source_version_drift")
    )
    drift = held.select("batch_id", "candidate_id", reason.alias("reason")).where("reason is not null")
    missing = asked.distinct().join(batches, "batch_id", "left_anti").select("batch_id", F.lit(0).cast("long").alias("candidate_id"), F.lit("batch_missing").alias("reason"))
    return drift.unionByName(missing)
