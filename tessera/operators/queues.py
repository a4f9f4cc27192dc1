"""Job queues, outbox, retention and state transitions over job tables.

``now`` is always passed in: operators don't read the clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def job_stats(jobs: DataFrame, by: list[str], created: str) -> DataFrame:
    return jobs.groupBy(*by).agg(F.count("*").alias("n"), F.min(created).alias("oldest"))


def queue_health(jobs: DataFrame, now: Column, waiting: list[str]) -> DataFrame:
    """Backlog, blocked jobs and the age in seconds of the oldest waiting one."""
    open_ = F.col("status").isin(*waiting)
    age = F.timestamp_diff("SECOND", F.min(F.when(open_, F.col("created_at"))), now)
    return jobs.agg(F.count_if(open_).alias("backlog"), F.count_if(F.col("status") == "blocked").alias("blocked"), F.coalesce(age, F.lit(0)).cast("long").alias("oldest_seconds"))


def claimable(jobs: DataFrame, now: Column, limit: int) -> DataFrame:
    """Jobs that are due or whose lease has run out, the earliest first."""
    due = F.col("status").isin("queued", "retry_wait") & (F.col("next_run_at") <= now)
    lapsed = (F.col("status") == "running") & (F.col("lease_until") < now)
    return jobs.where(due | lapsed).orderBy("next_run_at", "job_id").limit(limit)


def backoff_seconds(attempts: Column, base: int = 2, cap: int = 300) -> Column:
    return F.least(F.lit(float(cap)), F.lit(float(base)) * F.pow(F.lit(2.0), attempts))


def backoff_table(attempts: Column, steps: tuple[int, ...] = (60, 300, 900, 3600)) -> Column:
    """A fixed delay for each attempt from 1; null (blocked) beyond the table."""
    return F.when(attempts.between(1, len(steps)), F.element_at(F.array(*map(F.lit, steps)), attempts.cast("int")))


def settle(status_code: Column, attempts: Column, most: int = 8) -> Column:
    """done, retry or dead, by the answer's code (null: no answer) and the attempts so far."""
    again = status_code.isNull() | (status_code == 429) | (status_code >= 500)
    return F.when(status_code.between(200, 299), "done").when(again & (attempts < most), "retry").otherwise("dead")


def fail_transition(reason: Column, attempts: Column, most: Column) -> Column:
    """A failed job's next state: (status, attempts)."""
    status = F.when(reason == "lock_wait", "queued").when(reason == "post_commit", "retry_wait").when((reason == "permanent") | (attempts >= most), "failed").otherwise("retry_wait")
    return F.struct(status.alias("status"), F.when(reason == "lock_wait", F.greatest(attempts - 1, F.lit(0))).otherwise(attempts).alias("attempts"))


def expired(jobs: DataFrame, now: Column, finished: str, keep_days: dict[str, int]) -> DataFrame:
    """Jobs whose state is kept so many days after they finished, and which are past that."""
    late = F.lit(False)
    for status, days in keep_days.items():
        late = late | ((F.col("status") == status) & (F.col(finished) < now - F.expr(f"INTERVAL {days} DAYS")))
    return jobs.where(late)


def next_due_delay(jobs: DataFrame, now: Column, poll: int) -> DataFrame:
    """0 if a job is due, else the seconds to the next one, else the polling interval."""
    seconds = F.timestamp_diff("SECOND", now, F.min("next_run_at"))
    return jobs.agg(F.coalesce(F.greatest(seconds, F.lit(0)), F.lit(poll)).cast("long").alias("delay"))


def stale_verdicts(outbox: DataFrame, sessions: DataFrame, tombstones: DataFrame) -> DataFrame:
    """ok, or obsolete if the session is gone or another one, or has a tombstone."""
    joined = outbox.join(sessions.select("session_key", F.col("session_uuid").alias("_now")), "session_key", "left")
    dead = tombstones.select("session_key", "session_uuid", F.lit(True).alias("_dead")).distinct()
    joined = joined.join(dead, ["session_key", "session_uuid"], "left")
    gone = F.col("_now").isNull() | (F.col("_now") != F.col("session_uuid")) | F.coalesce("_dead", F.lit(False))
    return joined.withColumn("verdict", F.when(gone, "obsolete").otherwise("ok")).drop("_now", "_dead")


def delete_barrier(deletes: DataFrame, in_flight: DataFrame) -> DataFrame:
    """Deletes without a row in flight for the same session and the same, or an empty, uuid."""
    d, f = deletes.alias("d"), in_flight.alias("f")
    return d.join(f, (F.col("d.session_key") == F.col("f.session_key")) & F.col("f.session_uuid").isin(F.col("d.session_uuid"), F.lit("")), "left_anti")


def without_live(expired_rows: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """Expired rows that no live row refers to."""
    return expired_rows.join(live.select(key).distinct(), key, "left_anti")


def superseded(rows: DataFrame, key: str, version: str) -> DataFrame:
    """Rows with a newer version of the same key."""
    return rows.withColumn("_last", F.max(version).over(Window.partitionBy(key))).where(F.col(version) < F.col("_last")).drop("_last")


def page(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """A page of at most 200 rows with the total on each."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset(max(0, offset)).limit(min(200, max(1, limit))).crossJoin(F.broadcast(total))


def ingest_verdicts(incoming: DataFrame, held: DataFrame) -> DataFrame:
    """Each incoming (key, version, digest) against what is held: create, update, duplicate, conflict or stale."""
    last = held.groupBy("key").agg(F.max_by(F.struct("version", "digest"), "version").alias("_held"))
    joined = incoming.join(last, "key", "left")
    version, digest = F.col("_held.version"), F.col("_held.digest")
    verdict = (
        F.when(version.isNull(), "create").when(F.col("version") < version, "stale").when(F.col("version") > version, "update")
        .when(F.col("digest") == digest, "duplicate").otherwise("conflict")
    )
    return joined.withColumn("verdict", verdict).drop("_held")


def fold_uploads(chunks: DataFrame) -> DataFrame:
    """Uploads (upload_id, part, total, state) whose parts are all ready."""
    ready = F.countDistinct(F.when(F.col("state") == "ready", F.col("part")))
    return chunks.groupBy("upload_id").agg(ready.alias("ready"), F.max("total").alias("total")).withColumn("complete", F.col("ready") == F.col("total"))


def handoff_states(events: DataFrame) -> DataFrame:
    """Tickets from their events (ticket_id, seq, action, actor): the first claimer has it, the last resolution ends it."""
    claim = F.min(F.when(F.col("action") == "claim", F.struct("seq", "actor")))
    solved = F.max(F.when(F.col("action") == "resolve", F.col("seq")))
    grouped = events.groupBy("ticket_id").agg(claim.alias("_c"), solved.alias("resolved_seq"))
    status = F.when(F.col("resolved_seq").isNotNull(), "resolved").when(F.col("_c").isNotNull(), "claimed").otherwise("open")
    return grouped.select("ticket_id", F.col("_c.actor").alias("assignee"), status.alias("status"))


def outbox_backlog(jobs: DataFrame, now: Column) -> DataFrame:
    """Rows that are in flight, by status, with the longest wait in seconds."""
    flying = jobs.where(F.col("status").isin("queued", "running", "retry_wait"))
    return flying.groupBy("status").agg(F.count("*").alias("n"), F.timestamp_diff("SECOND", F.min("created_at"), now).alias("wait_seconds"))
