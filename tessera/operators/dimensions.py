"""Scores of single cases by dimension, recall by stratum, and decisions before publishing. A dimension that a case does not ask for is null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.claims import normalize_source


def _share(wanted: Column, found) -> Column:
    """The share of the wanted items that are found; null if nothing is wanted."""
    n = F.coalesce(F.size(wanted), F.lit(0))
    return F.when(n > 0, F.size(F.filter(wanted, found)) / n)


def says(reply: Column, word: Column) -> Column:
    """Whether a reply (null: empty) holds a word; commas don't matter for words with digits."""
    reply, bare = F.coalesce(reply, F.lit("")), lambda c: F.replace(c, F.lit(","), F.lit(""))
    return F.contains(reply, word) | (word.rlike(r"\d") & F.contains(bare(reply), bare(word)))


def tool_accuracy(wanted: Column, called: Column) -> Column:
    return _share(wanted, lambda t: F.array_contains(called, t))


def tool_efficiency(least: Column, calls: Column) -> Column:
    """The least number of calls by the real one, at most 1; without calls 1 if none was needed, else null."""
    return F.when((calls > 0) & least.isNotNull(), F.least(F.lit(1.0), least / calls)).when(least == 0, 1.0)


def same(wanted: Column, actual: Column) -> Column:
    """1 or 0 for an intent, a handover or another plain value; null if none is wanted."""
    return F.when(wanted.isNotNull(), wanted.eqNullSafe(actual).cast("double"))


def keyword_coverage(wanted: Column, reply: Column) -> Column:
    return _share(wanted, lambda w: says(reply, w))


def leak_free(forbidden: Column, reply: Column) -> Column:
    """0 if the reply holds a forbidden word, else 1; null if none is forbidden."""
    return F.when(F.size(forbidden) > 0, (~F.exists(forbidden, lambda w: says(reply, w))).cast("double"))


def citation_score(wanted: Column, strict: Column, matched: Column, missing: Column) -> Column:
    """The share of wanted sources among the matched ones. 0 without a verdict (matched is null), and with citations that were never retrieved if strict."""
    names = F.transform(matched, normalize_source)
    asked = F.coalesce(F.size(wanted), F.lit(0)) > 0
    bad = matched.isNull() | (strict & (F.coalesce(F.size(missing), F.lit(0)) > 0))
    return F.when((asked | strict) & bad, 0.0).otherwise(_share(wanted, lambda s: F.array_contains(names, normalize_source(s))))


def recall_by_stratum(cases: DataFrame) -> DataFrame:
    """(stratum, n, strict, loose) of cases (tags, expected, hits, layer): all, or any, of the expected sources were hit.

    Strata: timing (by tag; a hit in archive/ is a miss), condition (by tag), multihop (two or more sources), and layer:<layer>; but for timing only cases that expect something.
    """
    wanted = F.size("expected")
    tagged = lambda t: F.array_contains("tags", t)
    strata = F.array(
        F.when(tagged("timing"), "timing"), F.when(tagged("condition") & (wanted > 0), "condition"),
        F.when(wanted > 1, "multihop"), F.when(wanted > 0, F.concat(F.lit("layer:"), "layer")),
    )
    every = F.size(F.array_except("expected", "hits")) == 0
    current = (F.col("stratum") != "timing") | ~F.exists("hits", lambda h: h.startswith("archive/"))
    rows = cases.withColumn("stratum", F.explode(F.array_compact(strata)))
    return rows.groupBy("stratum").agg(F.count("*").alias("n"), F.avg((every & current).cast("double")).alias("strict"), F.avg(F.arrays_overlap("expected", "hits").cast("double")).alias("loose"))


def publish_decision(question: Column, answer: Column, kind: Column, target: Column, value: Column) -> Column:
    """duplicate, target_changed, replaced, answer_side or kept.

    question and answer are structs (path, near, authoritative, quality) of each side's nearest document. Only an update of the very document that was its target, with no less value, replaces it.
    """
    near = lambda side: F.coalesce(side["near"], F.lit(False))
    official = (near(question) & question["authoritative"]) | (near(answer) & answer["authoritative"])
    update = kind.eqNullSafe(F.lit("update"))
    moved = ~question["path"].eqNullSafe(target)
    worse = F.coalesce(value, F.lit(0.0)) < F.coalesce(question["quality"], F.lit(0.0))
    on_question = F.when(~update, "duplicate").when(moved, "target_changed").when(worse, "duplicate").otherwise("replaced")
    return F.when(official, "duplicate").when(near(question), on_question).when(near(answer), "answer_side").otherwise("kept")


def unanswered(messages: DataFrame) -> DataFrame:
    """(session, seq) of the user messages (session, seq, role) that the assistant doesn't answer next."""
    after = F.lead("role").over(Window.partitionBy("session").orderBy("seq"))
    return messages.withColumn("_next", after).where("role = 'user' and not _next <=> 'assistant'").select("session", "seq")
