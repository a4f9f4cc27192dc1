"""Page layout, canonical JSON and drift, digests of tool results."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import functions as F

from tessera.functions import digests
from tessera.operators import batches
from tessera.sources import layout

LINES = "doc int, page int, line int, text string, size double, level string"


def test_headings_and_margins(spark):
    rows = [(1, p, i, t, s, "mine") for p in range(4) for i, (t, s) in enumerate([("Hand  book", 9.0), ("", None), (f"Part {p}", 16.04), ("body text of this page", 10.0), (f"costs {p} points", 10.0), ("page 7", 8.0)])]
    rows += [(2, 0, i, f"size {s}", s, None) for i, s in enumerate([10.0, 10.0, 11.0, 12.0, 13.0, 14.0, 15.0, 16.0, 17.0, 10.9])] + [(3, 0, 0, None, None, None), (4, 0, 0, "Alone", 12.0, None), (4, 1, 0, "Alone", 12.0, None)]
    found = {(r["doc"], r["page"], r["line"]): r for r in layout.marked_lines(spark.createDataFrame(rows, LINES)).collect()}
    assert len(found) == len(rows)
    assert found[1, 2, 0]["margin"] and found[1, 2, 5]["margin"] and found[1, 2, 0]["rendered"] is None
    assert (found[1, 2, 2]["level"], found[1, 2, 2]["rendered"]) == (1, "# Part 2") and not found[1, 2, 4]["margin"] and found[1, 2, 1]["rendered"] == ""
    assert [found[2, 0, i]["level"] for i in range(10)] == [None, None, None, 6, 5, 4, 3, 2, 1, None]
    assert found[3, 0, 0]["rendered"] is None and not found[3, 0, 0]["margin"] and found[4, 1, 0]["rendered"] == "Alone"
    pages = {(r["doc"], r["page"]): (r["text"], r["rebuilt"]) for r in layout.page_texts(spark.createDataFrame(rows, LINES)).collect()}
    assert pages[1, 0] == ("\n# Part 0\nbody text of this page\ncosts 0 points", True) and pages[4, 0] == ("Alone", False)
    assert layout.marked_lines(spark.createDataFrame([], LINES)).count() == 0


def test_json_texts_equal_the_standard_library(spark):
    texts = ['a\\b"c\n\t\r\b\f\x00\x0b\x1f\x7f é漢😀 /', "", "\\u000b", None]
    found = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(batches.json_text(F.col("t"))).collect()]
    assert found == [json.dumps(t, ensure_ascii=False) for t in texts]
    values = [0.1, 1.0, 99.0, 1e-4, 5e-5, 1.5e-7, 1e16, 1.25e17, 123456789.125, 0.0, -0.0, 1 / 3, 2e15, -0.25, 1e300, -1.7e-300, 9999999999999998.0, None]
    found = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").coalesce(1).select(batches.json_double(F.col("v"))).collect()]
    assert found == [json.dumps(v) for v in values]


def test_digest_and_each_reason_for_drift(spark):
    item = "batch_id long, candidate_id long, candidate_revision int, source_version int, question string, answer string, value_score double, classification string, dedup_target_path string, approved_by string, approved_at timestamp_ntz"
    rows = [(1, i, None if i == 5 else 2, 1, 'q "x"', None if i == 1 else "é\n", 0.85, "good", None, "lead", None) for i in range(1, 9)]
    items = spark.createDataFrame(rows, item).withColumn("approval_digest", F.when(F.col("candidate_id") == 6, "x").when(F.col("candidate_id") != 8, batches.approval_digest()))
    snap = {"candidate_id": 1, "candidate_revision": 2, "source_version": 1, "question": 'q "x"', "answer": None, "value_score": 0.85, "classification": "good", "dedup_target_path": None, "approved_by": "lead", "approved_at": ""}
    assert items.where("candidate_id = 1").first()["approval_digest"] == hashlib.sha256(json.dumps(snap, ensure_ascii=False, sort_keys=True).encode()).hexdigest()
    candidates = spark.createDataFrame([(1, "publish_queued", 1, 2, 10), (3, "rejected", 1, 2, 10), (4, "publish_queued", None, 2, 10), (5, "publish_queued", 1, 0, 10), (6, "publish_queued", 1, 2, 10), (7, "publish_queued", 1, 2, 11), (8, "publish_queued", 1, 2, None)], "id long, status string, publish_batch_id long, revision int, conversation_id long")
    conversations = spark.createDataFrame([(10, "s", "a", 3), (11, "s", "b", 1), (12, "s", "b", 2)], "id long, source string, external_conversation_id string, source_version int")
    asked = spark.createDataFrame([(1,), (1,), (9,)], "batch_id long")
    found = {(r["batch_id"], r["candidate_id"]): r["reason"] for r in batches.batch_drift(asked, asked.where("batch_id = 1").distinct(), items, candidates, conversations).collect()}
    assert found == {(9, 0): "batch_missing", (1, 2): "candidate_missing", (1, 3): "candidate_rejected", (1, 4): "candidate_publish_queued", (1, 5): "revision_drift", (1, 6): "digest_mismatch", (1, 7): "source_version_drift", (1, 8): "digest_mismatch"}
    assert batches.batch_drift(asked.limit(0), asked, items, candidates, conversations).count() == 0


def test_tool_digests(spark):
    orders = json.dumps({"orders": [{"order_id": f"O{i}", "status": "paid", "items_summary": "s" * 50} for i in range(12)], "count": 15})
    cases = [
        ("query_order", '{"order":{"order_id":"A1","status":null,"total":99.0,"items":[{"name":"x"}]}}', "order_id=A1 status=None total=99.0 tracking_number= 商品=x"), ("query_order", '{"order":[1]}', '{"order":[1]}'),
        ("query_order", "{}", "order_id= status= total= tracking_number="), ("query_order", "x" * 300, "x" * 200 + "..."), ("new", '{"b":true,"a":1.50,"z":null,"n":{"q":1},"s":"h\\"y","i":3,"e":1e3}', '{"a": 1.5, "b": true, "e": 1000.0, "i": 3, "s": "h\\"y"}'),
        ("new", json.dumps({"t": "y" * 50}), '{"t": "' + "y" * 39 + '…"}'), ("load_skill", '{"success":true,"skill_name":"k"}', "已加载技能: k（指令略）"), ("search_knowledge", '{"results":[{"doc":"a"},{"doc":" a "},7,{"doc":"b"}]}', "命中2篇: a、b"),
        ("search_knowledge", '{"results":[]}', "命中0篇"), ("query_logistics", '{"logistics":{"carrier":"c","events":[{"time":"1"},{"time":"2","description":"out"}]}}', "tracking_number= carrier=c status= 最新=2 out"),
        ("list_user_orders", orders, " | ".join(f"O{i} paid sssssss…" for i in range(10)) + " …另有5单"), ("recall_user_memory", '{"m": "' + "z" * 300 + '"}', '{"m": "' + "z" * 192 + "…"), (None, '{"a":1}', '{"a": 1}'), ("new", None, None),
    ]
    frame = spark.createDataFrame([(i, t, c) for i, (t, c, _) in enumerate(cases)], "i int, tool string, content string")
    found = dict(frame.select("i", digests.tool_digest(F.col("tool"), F.col("content"))).collect())
    assert [found[i] for i in range(len(cases))] == [e for _, _, e in cases]
