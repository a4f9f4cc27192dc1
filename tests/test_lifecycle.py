"""States, evidence rules and folds on small known cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import lifecycle as lc


def test_transitions(spark):
    rows = spark.createDataFrame([("uploading", "queued"), ("deleted", "queued"), ("indexed", "deleting"), ("indexing", "cancelled"), (None, "queued"), ("queued", None)], "a string, b string")
    assert [r[0] for r in rows.select(lc.transition_allowed(F.col("a"), F.col("b"))).collect()] == [True, False, True, False, False, False]


def test_rewrites_must_be_plausible(spark):
    rows = spark.createDataFrame([("q", None), ("q", ""), ("q", "\n  “better question” \nmore"), ("q", "q"), ("q", "x" * 65), ("y" * 20, "x" * 80)], "q string, a string")
    found = [r[0] for r in rows.select(lc.rewritten_query(F.col("q"), F.col("a"))).collect()]
    assert found == ["q", "q", "better question", "q", "q", "x" * 80]
    rows = spark.createDataFrame([("q", "改写：‘退货 政策’"), ("q", "Rewrite : fine"), ("q", "根据指令，原样输出。q"), ("y" * 90, "x" * 200), ("y" * 90, "x" * 201)], "q string, a string")
    assert [r[0] for r in rows.select(lc.rewritten_query(F.col("q"), F.col("a"))).collect()] == ["退货 政策", "fine", "q", "x" * 200, "y" * 90]


def test_rerank_answers_of_all_shapes(spark):
    answers = ['{"results": [{"index": 2, "relevance_score": 0.5}, {"index": 1}, 3]}', "[[0, 0.25], [1]]", '[{"index": 4, "score": 1}]', "{}", "nonsense", None]
    found = lc.rerank_scores(spark.createDataFrame(list(enumerate(answers)), "query_id int, answer string")).collect()
    assert sorted(map(tuple, found)) == [(0, 2, 0.5), (1, 0, 0.25), (2, 4, 1.0)]


def test_parent_only_if_it_holds_the_hit(spark):
    rows = spark.createDataFrame([("b", "a b c"), ("| h |\nrow", "| h |\nx\nrow"), ("z", "a b c"), ("", "a"), ("b", None), (None, "a")], "body string, parent string")
    assert [r[0] for r in rows.select(lc.parent_or_self(F.col("body"), F.col("parent"), F.lit("| h |\n"))).collect()] == ["a b c", "| h |\nx\nrow", "z", "", "b", None]


def test_counters_restart(spark):
    rows = spark.createDataFrame([("m", f"2024-01-01 00:0{i}:00", v) for i, v in enumerate((5.0, 8.0, 2.0, 3.0))], "m string, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    assert [r["increase"] for r in lc.counter_increase(rows, "m", "1 hour").collect()] == [3.0 + 2.0 + 1.0]


def test_tainted_evidence_speaks_for_nothing(spark):
    items = spark.createDataFrame([(1, 1, 0.9, "a", True), (1, 2, 0.8, "b", False), (1, 3, 0.5, "a", False), (1, 4, 0.4, "b", False), (2, 1, 0.7, "c", True)], "query_id int, rank int, score double, source string, tainted boolean")
    found = {r["query_id"]: r for r in lc.evidence_diagnostics(items).collect()}
    assert found[1]["top1"] == 0.8 and round(found[1]["gap"], 9) == 0.3 and found[1]["sources"] == ["b", "a"] and found[1]["tainted"] == 1
    assert found[2]["n_items"] == 0 and found[2]["top1"] is None and found[2]["sources"] is None


def test_replacement_needs_the_questions_side(spark):
    rows = spark.createDataFrame([("question", "evolved/a.md", 0.9, 0.5), ("answer", "evolved/a.md", 0.9, 0.5), ("question", "uploads/a.md", 0.9, 0.5), ("question", "evolved/a.md", 0.4, 0.5), ("question", "evolved/b.md", 0.0, None)], "s string, p string, q double, o double")
    assert [r[0] for r in rows.select(lc.replaces(F.col("s"), F.col("p"), F.col("q"), F.col("o"))).collect()] == ["a.md", None, None, None, "b.md"]


def test_requests_without_a_key_are_spread(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        applications = spark.range(4096).select(F.col("id").alias("application_id"), (F.col("id") + 1).alias("order_id"), F.lit(7).cast("long").alias("user_id"))
        orders = spark.range(5000).select(F.col("id").alias("order_id"), F.lit(7).cast("long").alias("user_id"))
        none = F.when(F.col("id") < 0, F.col("id"))
        asked = spark.range(2000).select(F.col("id").alias("ask_id"), F.lit(7).cast("long").alias("user_id"), none.alias("application_id"), none.alias("order_id"))
        found = lc.refund_lookup(asked, applications, orders)
        assert max(r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()) < 1000
        assert {(r["code"], r["n"]) for r in found.collect()} == {("invalid", 0)}
        some = spark.createDataFrame([(1, 7, 3, None), (2, 8, 3, None), (3, 7, None, 3), (4, 7, None, 4500), (5, 7, None, 9000), (6, 7, 1, 1)], "ask_id long, user_id long, application_id long, order_id long")
        assert {r["ask_id"]: (r["code"], r["n"]) for r in lc.refund_lookup(some, applications, orders).collect()} == {1: ("ok", 1), 2: ("not_found", 0), 3: ("ok", 1), 4: ("ok", 0), 5: ("not_found", 0), 6: ("invalid", 0)}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
