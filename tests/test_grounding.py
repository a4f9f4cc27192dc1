"""Claims, conflicts, near-duplicate texts and the area under the curve against plain versions."""

from __future__ import annotations

import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import claims
from tessera.operators import evaluation, grounding, similar_texts


def anchors(spark, *clauses) -> list[str]:
    return [r[0] for r in spark.createDataFrame([(i, c) for i, c in enumerate(clauses)], "i int, c string").orderBy("i").select(grounding.anchor(F.col("c"))).collect()]


def test_anchors(spark):
    found = anchors(spark, "退款将在7天内到账", "预计到账需要3天", "本次目前配送 20 小时", "颜色共3件", "ＡＢＣ套餐 5 元", "Total cost 5 元", "7天", "  ")
    assert found == ["退款", "到账", "配送", "颜色", "套餐", "total", "", ""]


def test_a_clause_is_cleaned_once(spark):
    plan = spark.createDataFrame([("退款7天",)], "c string").select(grounding.anchor(F.col("c")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(") <= 2


def test_claims_are_taken_once_from_a_text(spark):
    evidence = spark.createDataFrame([(1, "退款7天，退货8天"), (1, "退款9天"), (2, "退款7天"), (None, "退款7天")], "case_id long, text string")
    found = grounding.evidence_claims(evidence)
    assert sorted(map(tuple, found.select("case_id", "anchor", "unit", "value", "several").collect())) == [(1, "退款", "天", "7", True), (1, "退款", "天", "9", True), (1, "退货", "天", "8", False), (2, "退款", "天", "7", False)]
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_conflicts_need_topic_unit_and_a_picked_value(spark):
    evidence = spark.createDataFrame(
        [(1, 0, "退款将在7天内到账，退货需要15天"), (1, 1, "退款周期为10天；金额1,000元"), (2, 0, "退款7天"), (3, 0, "退款7天"), (3, 1, "退款 9 天"), (4, 0, None), (5, 0, " ")], "case_id long, ord int, text string"
    )
    replies = spark.createDataFrame(
        [
            (1, "退款7天到账。退货15天！金额1,000 元；请稍候"), (2, "退款7天。退款8天。"), (3, "退款8天，退款 9 天。"), (4, "退款7天。"), (5, "转人工处理5天"), (6, "没有证据3天。"), (7, None), (3, ""),
        ], "case_id long, reply string",
    )
    found = sorted(tuple(r) for r in grounding.fact_conflicts(replies, evidence).collect())
    assert found == [(1, 0, 0, "7天"), (3, 0, 1, "9天")]
    rows = {(r["case_id"], r["claims_total"]): r for r in grounding.ground_replies(replies.where("reply <> '' or reply is null"), evidence).collect()}
    assert rows[1, 3]["reply"] == "退货15天！金额1,000 元；请稍候。" + grounding.CAUTION and rows[1, 3]["conflicts"] == ["7天"] and (rows[1, 3]["claims_grounded"], rows[1, 3]["removed_sentences"]) == (2, 1)
    assert rows[2, 2]["reply"] == "退款7天。" + grounding.CAUTION and rows[2, 2]["conflicts"] == []
    assert rows[3, 2]["reply"] == claims.FALLBACK_REPLY + grounding.CAUTION and rows[3, 2]["mentions_handoff"]
    assert [rows[i, 0]["reply"] for i in (4, 5, 6, 7)] == ["退款7天。", "转人工处理5天", "没有证据3天。", None] and rows[5, 0]["mentions_handoff"] and not rows[7, 0]["mentions_handoff"]


#: So many that none is popular, which the ratio would leave out.
MANY = [chr(0x4E00 + i) for i in range(250)]


def brute_pairs(rows: list[tuple], least: float = 0.9) -> dict:
    long = sorted((i, t) for i, t in rows if i is not None and t is not None and len(t) >= 500)
    return {(a, b): r for k, (a, x) in enumerate(long) for b, y in long[k + 1 :] if 2 * min(len(x), len(y)) > least * (len(x) + len(y)) and (r := SequenceMatcher(None, x, y).ratio()) > least}


def test_similar_texts_are_those_of_the_plain_ratio(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice(MANY) for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared, rows = prose(60), []
    for k in range(6):
        base = prose(130).split()
        for _ in range(6):
            changed = list(base)
            for _ in range(rng.randrange(0, 26)):
                at = rng.randrange(len(changed))
                changed[at : at + rng.randrange(2)] = [rng.choice(words)] * rng.randrange(2)
            rows.append((len(rows), " ".join(changed)))
    rows += [(100 + i, shared + " " + prose(80)) for i in range(12)] + [(200, rows[0][1]), (201, rows[0][1]), (202, None), (None, rows[0][1]), (203, "short"), (204, "é漢😀" * 300), (205, "é漢😀" * 299 + "x")]
    found = {(r["a"], r["b"]): r["ratio"] for r in similar_texts.similar_texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    first = {t: min(i for i, u in rows if u == t and i is not None) for _, t in rows if t is not None}
    wanted = brute_pairs([(i, t) for t, i in first.items()])
    assert len(wanted) > 20
    # The ratio depends on the order of a pair; a text stands for its copies.
    wanted |= {(first[t], i): 1.0 for i, t in rows if i is not None and t is not None and len(t) >= 500 and first[t] < i}
    assert found == pytest.approx(wanted) and (0, 200) in found


def test_bounds_lose_nothing():
    rng = random.Random(8)
    for _ in range(300):
        a = "".join(rng.choice("abcdefghij ") for _ in range(rng.randrange(20, 200)))
        b = "".join(c for c in a if rng.random() > 0.05) if rng.random() < 0.8 else a[::-1]
        ratio = SequenceMatcher(None, a, b).ratio()
        assert similar_texts.may_reach(similar_texts._counts(a), similar_texts._counts(b), ratio - 1e-9)


def test_hot_grams_are_joined_in_parts(spark, monkeypatch):
    monkeypatch.setattr(similar_texts, "PART", 3)
    rng = random.Random(6)
    base = "".join(rng.choice(MANY) for _ in range(600))
    rows = [(i, base[: 10 * i] + "#" + base[10 * i :]) for i in range(20)]
    found = {(r["a"], r["b"]) for r in similar_texts.similar_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == set(brute_pairs(rows)) and len(found) == 190


def test_differences_all_over_are_found(spark):
    rng = random.Random(9)
    base = "".join(rng.choice(MANY) for _ in range(600))
    rows = [(1, base), (2, "".join(c + "#" * (i % 9 == 8) for i, c in enumerate(base))), (3, base[::-1])]
    found = {(r["a"], r["b"]): r["ratio"] for r in similar_texts.similar_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == pytest.approx(brute_pairs(rows)) and (1, 2) in found


def test_blocks_meet_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(similar_texts, "PART", 5)
    monkeypatch.setattr(similar_texts, "ROUND_CHARS", 0, raising=False)
    rng = random.Random(12)
    bases = ["".join(rng.choice(MANY) for _ in range(600)) for _ in range(10)]
    rows = [(k, bases[k % 10][:k] + "#" + bases[k % 10][k:]) for k in range(60)]
    group = "blocks meet in rounds"
    spark.sparkContext.setJobGroup(group, group)
    found = {(r["a"], r["b"]): r["ratio"] for r in similar_texts.similar_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == pytest.approx(brute_pairs(rows)) and len(found) == 150
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # Twelve blocks: no step sends a text to all of them.
    tracker, store = spark.sparkContext.statusTracker(), spark.sparkContext._jsc.sc().statusStore()
    stages = {i for job in tracker.getJobIdsForGroup(group) for i in tracker.getJobInfo(job).stageIds if tracker.getStageInfo(i)}
    sent = [store.lastStageAttempt(i).shuffleWriteRecords() for i in stages]
    assert 60 <= max(sent) <= 2 * 60


def test_no_similar_texts(spark):
    assert similar_texts.similar_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_auc_is_exact_beyond_a_small_table(spark):
    n = 400_000
    rows = spark.range(n).select(((F.col("id") * 7919) % n / n).alias("score"), (F.pmod(F.xxhash64("id"), F.lit(100)) < 20 + 60 * ((F.col("id") * 7919) % n) / n).alias("positive"))
    held = rows.toPandas().sort_values("score")
    positive = held["positive"].to_numpy()
    negatives = np.cumsum(~positive)
    exact = negatives[positive].sum() / (positive.sum() * (~positive).sum())
    for k in (1, 3, 8):
        assert evaluation.auc(rows.repartition(k)).first()["auc"] == pytest.approx(exact, rel=1e-12)


def test_auc_of_ties_and_odd_rows(spark):
    rows = [(1.0, True), (1.0, False), (2.0, True), (float("nan"), False), (None, True), (3.0, None)]
    assert evaluation.auc(spark.createDataFrame(rows, "score double, positive boolean")).first()["auc"] == (0.5 + 0 + 1 + 0) / 4
    assert evaluation.auc(spark.createDataFrame([], "score double, positive boolean")).first()["auc"] is None
