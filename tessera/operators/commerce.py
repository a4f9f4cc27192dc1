"""Commerce lookups: owned orders, logistics, lists and costs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def lookup_orders(asked: DataFrame, orders: DataFrame) -> DataFrame:
    """Each request (order_id, user_id) with OK, NOT_FOUND or ACCESS_DENIED."""
    held = orders.select("order_id", F.col("user_id").alias("_owner"), "status")
    joined = asked.join(held, "order_id", "left")
    code = F.when(F.col("_owner").isNull(), "NOT_FOUND").when(F.col("_owner") != F.col("user_id"), "ACCESS_DENIED").otherwise("OK")
    return joined.withColumn("code", code).withColumn("status", F.when(code == "OK", F.col("status"))).drop("_owner")


def newest_orders(orders: DataFrame, limit: int) -> DataFrame:
    """Each user's newest orders with the number of all."""
    newest = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("order_id"))
    total = F.count("*").over(Window.partitionBy("user_id"))
    return orders.withColumn("total", total).withColumn("nth", F.row_number().over(newest)).where(F.col("nth") <= limit)


def usage_cost(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Calls, tokens and cost by model; a model without a price has no cost. prices are one row for each model."""
    joined = calls.join(F.broadcast(prices), "model", "left")
    cost = (F.col("prompt_tokens") * F.col("prompt_price") + F.col("completion_tokens") * F.col("completion_price")) / 1000
    return joined.groupBy("model").agg(F.count("*").alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.sum(cost).alias("cost"))
