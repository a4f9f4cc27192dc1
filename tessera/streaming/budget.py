"""Daily token budgets: calls reserve an estimate before they run and settle or release it afterwards, in batch and on a stream.

Events are (event_id, ts, user_id, day, action, reservation_id, tokens); ``day`` is the one on which a reservation was made, so that a settlement after midnight finds it.

* reserve: rejected if what the day has used, its open reservations and the estimate together reach the limit; a limit of 0 or less accepts all and reserves nothing. A reservation older
  than the time to live doesn't count any more. An id that was accepted before is accepted again and changes nothing.
* settle: the actual tokens are used in full, even if they exceed the estimate (overrun) or the reservation has expired; an id that isn't reserved, or was settled or released, is ignored.
* release: nothing is used; ignored as above.

Negative and null tokens count as 0. Within a batch a user's events of a day are taken in order of ts and event_id; on a stream each micro-batch is, after those before it, so
an event that comes late is decided by what has come until then: a settlement before its reservation is ignored. Each decision depends on all before it, so a user's day is taken in order:
in a batch, partitions hold whole days, sorted, and are read through once with the day at hand alone in memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

TTL_SECONDS = 600
#: A stream forgets a user's day so long after the day began.
KEEP_SECONDS = 3 * 86_400
RESULT = "event_id long, user_id long, day date, verdict string, used long, overrun long"


#: The second of an event without a time: before all others, so that no reservation has expired then.
_NO_TIME = -(1 << 63)


class _Day:
    """What a user's day has used, and its reservations (estimate, second, open) by id; sums of the open ones are carried on from event to event."""

    def __init__(self, used: int, held: dict[str, tuple[int, int, bool]], limit: int, ttl: int):
        self.used, self.held, self.limit, self.ttl = used, held, limit, ttl
        self.open, self.live, self.now, self.all, self.sum, self.count = [], {}, _NO_TIME, 0, 0, 0
        for name, (estimate, since, is_open) in held.items():
            if is_open:
                self._add(name, estimate, since)

    def _add(self, name: str, estimate: int, since: int) -> None:
        # Ids needn't be comparable: a running number tells entries of one second apart.
        heappush(self.open, (since, self.count, name))
        self.live[name], self.count = estimate, self.count + 1
        self.all, self.sum = self.all + estimate, self.sum + estimate

    def reserved(self, at: int) -> int:
        """The open reservations of at most the time to live."""
        if at == _NO_TIME:
            return self.all
        if at < self.now:
            return sum(e for e, since, is_open in self.held.values() if is_open and at - since <= self.ttl)
        self.now = at
        while self.open and at - self.open[0][0] > self.ttl:
            self.sum -= self.live.pop(heappop(self.open)[-1], 0)
        return self.sum

    def take(self, action: str, name: str, at: int, n: int) -> tuple[str, int]:
        """Verdict and overrun of the next event."""
        if action == "reserve":
            if self.limit <= 0 or name in self.held:
                return "accepted", 0
            if self.used + self.reserved(at) + n >= self.limit:
                return "rejected", 0
            self.held[name] = (n, at, True)
            self._add(name, n, at)
            return "accepted", 0
        if name not in self.held or not self.held[name][2]:
            return "ignored", 0
        estimate, since, _ = self.held[name]
        self.held[name] = (estimate, since, False)
        self.all, self.sum = self.all - estimate, self.sum - self.live.pop(name, 0)
        if action != "settle":
            return "released", 0
        self.used += n
        return "settled", max(0, n - estimate)


def decide(rows: pd.DataFrame, used: int, held: dict[str, tuple[int, int, bool]], limit: int, ttl: int) -> tuple[pd.DataFrame, int]:
    """RESULT of the rows of a user's day and what it has used then; ``held`` (estimate, second, open) by id is carried on."""
    rows = rows.sort_values(["ts", "event_id"])
    seconds = rows["ts"].astype("datetime64[s]").astype("int64")
    tokens = pd.to_numeric(rows["tokens"]).fillna(0).clip(lower=0).astype("int64")
    day, verdicts, sums, overruns = _Day(used, held, limit, ttl), [], [], []
    for event in zip(rows["action"], rows["reservation_id"], seconds, tokens, strict=True):
        verdict, overrun = day.take(*event)
        verdicts.append(verdict)
        sums.append(day.used)
        overruns.append(overrun)
    return pd.DataFrame({"event_id": rows["event_id"], "user_id": rows["user_id"], "day": rows["day"], "verdict": verdicts, "used": sums, "overrun": overruns}), day.used


def daily_budget(events: DataFrame, limit: int, ttl: int = TTL_SECONDS) -> DataFrame:
    """RESULT of each event."""
    at, tokens = F.coalesce(F.unix_seconds(F.col("ts").cast("timestamp")), F.lit(_NO_TIME)), F.greatest(F.coalesce(F.col("tokens").cast("long"), F.lit(0)), F.lit(0))
    rows = events.repartition("user_id", "day").sortWithinPartitions("user_id", "day", F.asc_nulls_last("ts"), F.asc_nulls_last("event_id"))
    rows = rows.select(F.col("event_id").cast("long"), F.col("user_id").cast("long"), F.col("day").cast("date"), "action", "reservation_id", at.alias("at"), tokens.alias("tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, day = None, None
        for batch in batches:
            verdicts, sums, overruns = [], [], []
            columns = [batch.column(c).to_pylist() for c in ("user_id", "action", "reservation_id", "at", "tokens")]
            for user, date, *event in zip(columns[0], batch.column("day").cast(pa.int32()).to_pylist(), *columns[1:], strict=True):
                if day is None or key != (user, date):
                    key, day = (user, date), _Day(0, {}, limit, ttl)
                verdict, overrun = day.take(*event)
                verdicts.append(verdict)
                sums.append(day.used)
                overruns.append(overrun)
            out = [*(batch.column(c) for c in ("event_id", "user_id", "day")), pa.array(verdicts, pa.string()), pa.array(sums, pa.int64()), pa.array(overruns, pa.int64())]
            yield pa.RecordBatch.from_arrays(out, ["event_id", "user_id", "day", "verdict", "used", "overrun"])

    return rows.mapInArrow(run, RESULT)


class _Budget(StatefulProcessor):
    def __init__(self, limit: int, ttl: int):
        self.limit, self.ttl = limit, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.used = handle.getValueState("used", "used long")
        self.held = handle.getMapState("held", "reservation_id string", "estimate long, since long, open boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        used = self.used.get()[0] if self.used.exists() else 0
        if not self.used.exists():
            self.handle.registerTimer((pd.Timestamp(key[1]).value // 10**9 + KEEP_SECONDS) * 1000)
        before = {k[0]: tuple(v) for k, v in self.held.iterator()}
        held = dict(before)
        found, used = decide(pd.concat(list(rows)), used, held, self.limit, self.ttl)
        self.used.update((used,))
        for name, value in held.items():
            if before.get(name) != value:
                self.held.updateValue((name,), value)
        yield found

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.used.clear()
        self.held.clear()
        yield pd.DataFrame({"event_id": [], "user_id": [], "day": [], "verdict": [], "used": [], "overrun": []})

    def close(self) -> None:
        pass


def budget_stream(events: DataFrame, limit: int, ttl: int = TTL_SECONDS, lateness: str = "1 hour") -> DataFrame:
    """The same on a stream. It needs the RocksDB state store; a user's day goes by a timer once the watermark has passed KEEP_SECONDS after its start."""
    watched = events.withWatermark("ts", lateness)
    return watched.groupBy("user_id", "day").transformWithStateInPandas(statefulProcessor=_Budget(limit, ttl), outputStructType=RESULT, outputMode="append", timeMode="EventTime")
