"""Queries whose results SQL can't state: approximate search, query normalising, budgets. Tests hold them against exact or plain versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import ann, mining, spelling
from tessera.plans._tables import Query, table, vectors
from tessera.streaming import budget

_LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: A Han character for each letter; neighbours (a and b, c and d, ...) sound alike.
_HAN = "".join(chr(0x4E00 + 40 * i) for i in range(26))


def es_ann(spark: SparkSession, sf: str) -> DataFrame:
    """The ten nearest vectors of each hundredth one, by an inverted file."""
    every = vectors(spark, sf)
    asked = every.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), "vector")
    return ann.ann_neighbours(every, asked, 10, drop_self=True)


def query_normalize(spark: SparkSession, sf: str) -> DataFrame:
    """Messages, their letters written as Han characters with e and k spoilt, put back into the frequent words of all messages."""
    messages = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    words = mining.frequent_ngrams(messages.select(F.col("conv_id").alias("id"), text.tokens(F.col("text")).alias("words")), 1, 5)
    lexicon = words.select(F.translate("gram", _LETTERS, _HAN).alias("term"), F.col("freq"), F.lit(False).alias("guard"))
    syllables = spark.createDataFrame([(c, f"{_LETTERS[i // 2]}{i // 2}") for i, c in enumerate(_HAN)], "char string, syllable string")
    spoilt = _HAN.replace(_HAN[4], _HAN[5]).replace(_HAN[10], _LETTERS[5])
    queries = messages.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.translate(F.lower("text"), _LETTERS, spoilt).alias("query"))
    return spelling.normalize_queries(queries, lexicon, syllables).select("query_id", "text", F.size("rewrites").alias("n_rewrites"))


def daily_budget(spark: SparkSession, sf: str) -> DataFrame:
    """Each event reserves ten times its value and settles (purchases: a tenth more, others: half) or releases it (errors) five minutes later."""
    e = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", F.floor(F.col("value") * 10).cast("long").alias("n"))
    name, day = F.col("event_id").cast("string").alias("reservation_id"), F.to_date("ts").alias("day")
    reserve = e.select((F.col("event_id") * 2).alias("event_id"), "ts", "user_id", day, F.lit("reserve").alias("action"), name, F.col("n").alias("tokens"))
    action = F.when(F.col("event_type") == "error", "release").otherwise("settle").alias("action")
    tokens = F.when(F.col("event_type") == "purchase", F.floor(F.col("n") * 1.1)).otherwise(F.floor(F.col("n") / 2)).cast("long").alias("tokens")
    settle = e.select((F.col("event_id") * 2 + 1).alias("event_id"), (F.col("ts") + F.expr("INTERVAL 5 MINUTES")).alias("ts"), "user_id", day, action, name, tokens)
    return budget.daily_budget(reserve.unionByName(settle), 1000)


QUERIES: dict[str, Query] = {f.__name__: f for f in (es_ann, query_normalize, daily_budget)}
