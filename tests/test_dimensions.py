"""Scores by dimension and decisions on small known cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import dimensions as dim


def test_what_is_not_asked_for_is_null(spark):
    row = spark.range(1).select(
        dim.tool_accuracy(F.array().cast("array<string>"), F.array(F.lit("a"))), dim.tool_efficiency(F.lit(None).cast("int"), F.lit(3)), dim.same(F.lit(None).cast("string"), F.lit("a")),
        dim.keyword_coverage(F.lit(None).cast("array<string>"), F.lit("a")), dim.leak_free(F.array().cast("array<string>"), F.lit("a")), dim.citation_score(F.array().cast("array<string>"), F.lit(False), F.array(F.lit("a")), F.array(F.lit("b"))),
    ).first()
    assert list(row) == [None] * 6


def test_numbers_and_missing_verdicts(spark):
    none = F.lit(None).cast("array<string>")
    row = spark.range(1).select(
        dim.keyword_coverage(F.array(F.lit("4299"), F.lit("x,y")), F.lit("it costs 4,299.00 xy")), dim.leak_free(F.array(F.lit("1799")), F.lit("1,799")), dim.leak_free(F.array(F.lit("a")), F.lit(None).cast("string")),
        dim.citation_score(F.array(F.lit("a")), F.lit(False), none, none), dim.tool_efficiency(F.lit(0), F.lit(0)), dim.tool_efficiency(F.lit(2), F.lit(0)), dim.same(F.lit("a"), F.lit(None).cast("string")),
    ).first()
    assert list(row) == [0.5, 0.0, 1.0, 0.0, 1.0, None, 0.0]


def test_publishing_needs_the_same_target(spark):
    schema = "q struct<path: string, near: boolean, authoritative: boolean, quality: double>, a struct<path: string, near: boolean, authoritative: boolean, quality: double>, kind string, target string, value double"
    far = ("p", False, True, 0.0)
    rows = [
        (far, far, "new", None, 0.1), (("p", True, True, 0.0), far, "update", "p", 1.0), (("p", True, False, 0.5), far, "update", "p", 0.5), (("p", True, False, 0.5), far, "update", None, 0.5),
        (("p", True, False, 0.5), far, "update", "p", 0.4), (far, ("p", True, False, 0.1), "update", "p", 1.0), (None, None, None, None, None), (("p", True, False, 0.5), far, None, "p", 0.9),
    ]
    found = [r[0] for r in spark.createDataFrame(rows, schema).select(dim.publish_decision(F.col("q"), F.col("a"), F.col("kind"), F.col("target"), F.col("value"))).collect()]
    assert found == ["kept", "duplicate", "replaced", "target_changed", "duplicate", "answer_side", "kept", "duplicate"]


def test_unanswered_messages(spark):
    rows = spark.createDataFrame([(1, 0, "user"), (1, 1, "user"), (1, 2, "assistant"), (2, 0, "user")], "session int, seq int, role string")
    assert sorted(map(tuple, dim.unanswered(rows).collect())) == [(1, 0), (2, 0)]
