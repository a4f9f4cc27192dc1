"""Windows over events (event_id, ts, user_id, event_type, value): rates, quantiles, spikes, limits and gaps.

The first group works on streams and batches alike; the second needs whole histories and is for batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Upper bounds of a histogram's buckets.
BUCKETS = (1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0)


def rate(events: DataFrame, length: str = "5 minutes", seconds: int = 300) -> DataFrame:
    """Events a second and their sum by type in tumbling windows."""
    grouped = events.groupBy(F.window("ts", length).alias("w"), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", (F.col("n") / F.lit(float(seconds))).alias("rate"), "total")


def sliding_count(events: DataFrame, length: str, step: str) -> DataFrame:
    grouped = events.groupBy(F.window("ts", length, step).alias("w"), "event_type")
    return grouped.agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """A user's runs of events with no pause of ``gap`` or more."""
    grouped = events.groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return grouped.agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_of_each(events: DataFrame, late: str) -> DataFrame:
    """Drop repeats of an event id within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def sliding_limit(events: DataFrame, seconds: int, most: int) -> DataFrame:
    """Recording variant: every hit counts, one exactly ``seconds`` old doesn't; more than ``most`` is rejected."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    hits = F.count("*").over(Window.partitionBy("user_id").orderBy(at).rangeBetween(-(seconds * 1_000_000 - 1), 0))
    return events.withColumn("hits", hits).withColumn("allowed", F.col("hits") <= most)


def sliding_limit_stateful(events: DataFrame, seconds: int, most: int) -> DataFrame:
    """Non-recording variant: rejected hits don't count and one exactly ``seconds`` old does; a user's hits are folded in order."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["ts", "event_id"])
        held: list[pd.Timestamp] = []
        allowed = []
        for at in rows["ts"]:
            held = [t for t in held if (at - t).total_seconds() <= seconds]
            allowed.append(len(held) < most)
            if allowed[-1]:
                held.append(at)
        return pd.DataFrame({"event_id": rows["event_id"], "user_id": rows["user_id"], "allowed": allowed})

    return events.select("event_id", "user_id", "ts").groupBy("user_id").applyInPandas(fold, "event_id long, user_id long, allowed boolean")


def limit_stream(events: DataFrame, seconds: int, most: int) -> DataFrame:
    """The non-recording limit on a stream: the user's accepted times are its state, and go when they are too old to matter."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        allowed = []
        for at in rows["ts"].astype("int64") // 1000 if str(rows["ts"].dtype).endswith("[ns]") else rows["ts"].astype("int64"):
            held = [t for t in held if at - t <= seconds * 1_000_000]
            allowed.append(len(held) < most)
            if allowed[-1]:
                held.append(int(at))
        state.update((held,))
        yield pd.DataFrame({"event_id": rows["event_id"], "user_id": key[0], "allowed": allowed})

    return events.groupBy("user_id").applyInPandasWithState(step, "event_id long, user_id long, allowed boolean", "held array<long>", "append", GroupStateTimeout.NoTimeout)


def histogram(events: DataFrame, bounds: tuple[float, ...] = BUCKETS) -> DataFrame:
    """Cumulative buckets by type: (event_type, le, n), the last one without a bound."""
    counts = [F.count_if(F.col("value") <= b) for b in bounds] + [F.count("value")]
    pairs = F.array(*[F.struct(F.lit(b).alias("le"), c.alias("n")) for b, c in zip((*bounds, float("inf")), counts, strict=True)])
    return events.groupBy("event_type").agg(pairs.alias("b")).select("event_type", F.inline("b"))


def histogram_quantile(buckets: DataFrame, q: float) -> DataFrame:
    """Linear inside the first bucket that reaches the quantile; the last bound if it lies beyond."""
    order = Window.partitionBy("event_type").orderBy("le")
    rows = buckets.withColumn("low", F.coalesce(F.lag("le").over(order), F.lit(0.0))).withColumn("below", F.coalesce(F.lag("n").over(order), F.lit(0)))
    rows = rows.withColumn("want", F.max("n").over(Window.partitionBy("event_type")) * F.lit(q)).where(F.col("n") >= F.col("want"))
    first = rows.withColumn("_r", F.row_number().over(order)).where("_r = 1")
    inside = F.col("low") + (F.col("le") - F.col("low")) * (F.col("want") - F.col("below")) / (F.col("n") - F.col("below"))
    return first.select("event_type", F.when(F.col("le") == float("inf"), F.col("low")).otherwise(inside).alias("quantile"))


def top_users(events: DataFrame, k: int) -> DataFrame:
    """Each day's k users of the largest sum."""
    daily = events.groupBy(F.window("ts", "24 hours").alias("w"), "user_id").agg(F.sum("value").alias("total")).select(F.col("w.start").alias("day"), "user_id", F.round("total", 6).alias("total"))
    return daily.withColumn("rank", F.row_number().over(Window.partitionBy("day").orderBy(F.desc("total"), "user_id"))).where(F.col("rank") <= k)


def spikes(hourly: DataFrame, factor: float, hours: int = 24) -> DataFrame:
    """Hours (event_type, hour, n) whose count is above ``factor`` times the mean of the hours before, up to a day."""
    at = F.unix_seconds(F.col("hour").cast("timestamp"))
    before = Window.partitionBy("event_type").orderBy(at).rangeBetween(-hours * 3600, -1)
    return hourly.withColumn("mean_before", F.avg("n").over(before)).where(F.col("n") > factor * F.col("mean_before"))


def held_for(states: DataFrame, condition: Column, n: int, by: str, order: str) -> DataFrame:
    """Runs of at least n rows in a row for which the condition holds: (by, start, end, n)."""
    w = Window.partitionBy(by).orderBy(order)
    marked = states.withColumn("_on", condition).withColumn("_all", F.row_number().over(w))
    runs = marked.where("_on").withColumn("_run", F.col("_all") - F.row_number().over(w))
    return runs.groupBy(by, "_run").agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count("*").alias("n")).where(F.col("n") >= n).drop("_run")


def daily_budget(calls: DataFrame, limit: int) -> DataFrame:
    """Calls (call_id, ts, user_id, estimate, actual) against a budget for each user and day, in order of time.

    A call is rejected if what the day's accepted calls have used and its own estimate reach the limit; a rejected one uses nothing. A user's
    day is one group, since each decision depends on those before it.
    """

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["ts", "call_id"])
        used, allowed = 0, []
        for estimate, actual in zip(rows["estimate"], rows["actual"], strict=True):
            allowed.append(used + estimate < limit)
            used += actual if allowed[-1] else 0
        return pd.DataFrame({"call_id": rows["call_id"], "user_id": rows["user_id"], "day": rows["day"], "allowed": allowed})

    days = calls.withColumn("day", F.to_date("ts"))
    return days.groupBy("user_id", "day").applyInPandas(fold, "call_id long, user_id long, day date, allowed boolean")
