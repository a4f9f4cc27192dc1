"""Replies held against evidence: claims by topic and unit, conflicts among the evidence, grounded sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.claims import CLAIM, FALLBACK_REPLY, claims, grounded, joined_thousands

# Topics in order of preference, words that may stand before a topic, and what is added to a cut reply.
TOPICS = ("退款", "退货", "换货", "到货", "发货", "物流", "配送", "到账", "支付", "订单", "保修", "客服", "响应")
MODIFIERS = ("本次", "此次", "这次", "该次", "当前", "目前", "预计", "通常", "一般", "大约", "约")
HANDOFF = "转人工"
CAUTION = "以上信息以官方政策与实际到账为准，如需精确确认可转人工核实。"
SENTENCE_ENDS = ("。", "！", "？", "?")

_NUMBER = r"\d+(?:\.\d+)?"
_FULL_WIDTH, _ASCII = "".join(chr(0xFF01 + i) for i in range(94)) + "　", "".join(chr(0x21 + i) for i in range(94)) + " "


def sentences(text: Column) -> Column:
    """The text cut behind each end of a sentence or line."""
    return F.filter(F.split(text, r"(?<=[。！？!?；;\n])"), lambda s: s != "")


def anchor(clause: Column) -> Column:
    """What a clause is about: its first topic in order of preference, else its first two Han characters, else its first ASCII word in lower case, else nothing.

    Full-width forms count as ASCII; claims, numbers and modifiers in front are left out first.
    """
    plain = F.regexp_replace(F.regexp_replace(clause, CLAIM, " "), _NUMBER, " ")
    clean = F.regexp_replace(F.trim(F.translate(plain, _FULL_WIDTH, _ASCII)), f"^(?:{'|'.join(MODIFIERS)})+", "")

    def first_of(clean: Column) -> Column:
        pick = lambda pattern: F.nullif(F.regexp_extract(clean, pattern, 0), F.lit(""))
        topic = F.coalesce(*(F.when(F.contains(clean, F.lit(t)), t) for t in TOPICS))
        return F.coalesce(topic, pick(r"[\x{4e00}-\x{9fff}]{2}"), F.lower(pick("[A-Za-z0-9]{2,}")), F.lit(""))

    # As an element of an array the clean clause is made once, not for each topic.
    return F.transform(F.array(clean), first_of)[0]


def topic_claims(text: Column) -> Column:
    """An array of (anchor, unit, value) of each claim, clause by clause."""
    clauses = F.filter(F.split(joined_thousands(text), "[，,；;、\n]"), lambda c: F.regexp_replace(c, r"\s+", "") != "")
    of_clause = lambda c: F.transform(
        F.regexp_extract_all(F.regexp_replace(c, r"\s+", ""), F.lit(CLAIM), F.lit(0)),
        lambda m: F.struct(anchor(c).alias("anchor"), F.regexp_replace(m, f"^{_NUMBER}", "").alias("unit"), F.regexp_extract(m, _NUMBER, 0).alias("value")),
    )
    return F.flatten(F.transform(clauses, of_clause))


def evidence_claims(evidence: DataFrame) -> DataFrame:
    """The distinct (case_id, anchor, unit, value) of evidence (case_id, text), and whether its key has several values in its case."""
    found = evidence.select("case_id", F.explode(topic_claims(F.col("text"))).alias("c")).select("case_id", "c.*").distinct()
    # A window, and no join with a group's own aggregate: else the texts would be gone through twice.
    values = Window.partitionBy("case_id", "anchor", "unit")
    return found.where("case_id IS NOT NULL").withColumn("several", F.min("value").over(values) < F.max("value").over(values))


def fact_conflicts(replies: DataFrame, evidence: DataFrame) -> DataFrame:
    """(case_id, pos, k, claim) of claims of replies (case_id, reply) that pick one of several values which the case's evidence has for the same topic and unit.

    pos and k: places of the sentence and of the claim in it. Claims meet their evidence by equality; nothing is gathered.
    """
    sent = replies.select("case_id", F.posexplode(sentences(F.col("reply"))).alias("pos", "sentence"))
    said = sent.select("case_id", "pos", F.posexplode(topic_claims(F.col("sentence"))).alias("k", "c")).select("case_id", "pos", "k", "c.*")
    torn = evidence_claims(evidence).where("several").drop("several")
    return said.join(torn, ["case_id", "anchor", "unit", "value"]).select("case_id", "pos", "k", F.concat("value", "unit").alias("claim"))


def ground_replies(replies: DataFrame, evidence: DataFrame) -> DataFrame:
    """Replies (case_id, reply) without the sentences whose claims the evidence (case_id, ord, text) doesn't have or contradicts itself on.

    Returns case_id, reply, claims_total, claims_grounded, removed_sentences, conflicts (distinct, in order) and mentions_handoff. A case without evidence keeps
    its reply, with nothing counted; a reply that loses all its sentences becomes FALLBACK_REPLY, one that loses some gets a full stop and CAUTION. The texts of one case,
    few by their meaning, are joined in their order, since a claim may stand in any of them.
    """
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda x: F.coalesce(x["text"], F.lit("")))
    blobs = evidence.groupBy("case_id").agg(F.array_join(ordered, "").alias("blob"))
    torn = fact_conflicts(replies, evidence).groupBy("case_id", "pos").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "claim"))), lambda x: x["claim"]).alias("torn"))
    held = replies.join(blobs, "case_id", "left").withColumn("blob", F.coalesce("blob", F.lit("")))
    checked = F.regexp_replace("blob", r"\s+", "") != ""
    sent = held.where(checked).select("case_id", "blob", F.posexplode(sentences(F.col("reply"))).alias("pos", "sentence")).join(torn, ["case_id", "pos"], "left")
    sent = sent.select("case_id", "pos", "sentence", F.size(claims(F.col("sentence"))).alias("n"), F.coalesce("torn", F.array().cast("array<string>")).alias("torn"), grounded(F.col("sentence"), F.col("blob")).alias("found"))
    stay = F.col("found") & (F.size("torn") == 0)
    in_order = lambda value: F.transform(F.sort_array(F.collect_list(F.struct("pos", value.alias("v")))), lambda x: x["v"])
    folded = sent.groupBy("case_id").agg(
        F.trim(F.array_join(in_order(F.when(stay, F.col("sentence")).otherwise("")), "")).alias("kept"), F.sum("n").alias("claims_total"),
        F.sum(F.when(stay, F.col("n")).otherwise(0)).alias("claims_grounded"), F.count_if(~stay).alias("removed_sentences"), F.array_distinct(F.flatten(in_order(F.col("torn")))).alias("conflicts"),
    )
    out = held.select("case_id", "reply").join(folded, "case_id", "left")
    whole, cut = F.col("kept").isNull(), F.col("removed_sentences") > 0
    ended = F.when(F.col("kept").rlike(f"[{''.join(SENTENCE_ENDS)}]$"), F.col("kept")).otherwise(F.concat("kept", F.lit("。")))
    fallback = cut & (F.col("kept") == "")
    reply = F.when(whole, F.col("reply")).when(fallback, FALLBACK_REPLY).when(cut, ended).otherwise(F.col("kept"))
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(
        "case_id", F.when(~whole & cut, F.concat(reply, F.lit(CAUTION))).otherwise(reply).alias("reply"), count("claims_total"), count("claims_grounded"), count("removed_sentences"),
        F.coalesce("conflicts", F.array().cast("array<string>")).alias("conflicts"), F.coalesce(F.contains("reply", F.lit(HANDOFF)) | F.coalesce(fallback, F.lit(False)), F.lit(False)).alias("mentions_handoff"),
    )
