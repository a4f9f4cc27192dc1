"""Conversations: turns, final answers, tool calls, budgets and nearest customer messages.

Messages are (session, seq, role, text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import estimate_tokens


def sessionize(messages: DataFrame) -> DataFrame:
    """Adds msg_index, the turn from 0; a turn starts at each user message, and what comes before the first is dropped."""
    running = Window.partitionBy("session").orderBy("seq")
    turn = F.sum((F.col("role") == "user").cast("int")).over(running)
    return messages.withColumn("msg_index", turn - 1).where("msg_index >= 0")


def turns(messages: DataFrame) -> DataFrame:
    """(session, msg_index, question, answer): each turn's user message and its last assistant message; turns without one go."""
    rows = sessionize(messages)
    answer = F.max_by("text", F.when(F.col("role") == "assistant", F.col("seq")))
    question = F.max_by("text", F.when(F.col("role") == "user", F.col("seq")))
    grouped = rows.groupBy("session", "msg_index").agg(question.alias("question"), answer.alias("answer"), F.count_if(F.col("role") == "assistant").alias("_n"))
    return grouped.where("_n > 0").drop("_n")


def suffix_budget(messages: DataFrame, budget: int, overhead: int = 4) -> DataFrame:
    """The newest messages whose tokens fit together; the last one always; no tool message in front."""
    cost = estimate_tokens(F.col("text")) + overhead
    newest = Window.partitionBy("session").orderBy(F.desc("seq"))
    rows = messages.withColumn("_used", F.sum(cost).over(newest)).withColumn("_nth", F.row_number().over(newest))
    kept = rows.where((F.col("_used") <= budget) | (F.col("_nth") == 1))
    first = F.min(F.when(F.col("role") != "tool", F.col("seq"))).over(Window.partitionBy("session"))
    return kept.withColumn("_first", first).where(F.col("seq") >= F.coalesce("_first", F.col("seq"))).drop("_used", "_nth", "_first")


def nearest_customer(messages: DataFrame, customer: str = "user") -> DataFrame:
    """For every other message the seq of the nearest customer message before it and after it."""
    seq = F.when(F.col("role") == customer, F.col("seq"))
    before = Window.partitionBy("session").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("session").orderBy("seq").rowsBetween(1, Window.unboundedFollowing)
    rows = messages.withColumn("previous_seq", F.last(seq, ignorenulls=True).over(before)).withColumn("next_seq", F.first(seq, ignorenulls=True).over(after))
    return rows.where(F.col("role") != customer)


def join_tool_calls(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Calls (session, turn, call_id, name) with the last result (session, turn, call_id, seq, result) of the same id."""
    last = results.groupBy("session", "turn", "call_id").agg(F.max_by("result", "seq").alias("result"))
    return calls.join(last, ["session", "turn", "call_id"], "left")


def search_messages(messages: DataFrame, term: str, tombstones: DataFrame, limit: int = 200) -> DataFrame:
    """Newest messages with a term; those of removed sessions go, and of repeats of (session, seq) the newest stays."""
    found = messages.where(F.contains(F.lower("text"), F.lit(term.lower()))).join(tombstones.select("session").distinct(), "session", "left_anti")
    newest = Window.partitionBy("session", "seq").orderBy(F.desc("ts"))
    return found.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n").orderBy(F.desc("ts"), "session", "seq").limit(min(limit, 200))


def consume(messages: DataFrame, marks: DataFrame) -> DataFrame:
    """Messages after a session's mark and up to its through_seq; a session that is past it has none."""
    joined = messages.join(marks, "session")
    return joined.where((F.col("seq") > F.col("mark")) & (F.col("seq") <= F.col("through_seq"))).drop("mark", "through_seq")


def final_reply(text: Column) -> Column:
    """The reply in a JSON answer, or the text itself if it isn't one."""
    parsed = F.from_json(text, "reply string, intent string, confidence double")
    return F.coalesce(parsed["reply"], text)
