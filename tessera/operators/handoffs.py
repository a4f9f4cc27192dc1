"""Handoff tickets from their events: what each event did, and how each ticket stands, in batch and on a stream.

Events are (event_id, seq, ticket_id, action, actor, resolution), in order of seq, then event_id:

* create: created, or repeated if the ticket is there.
* claim: claimed; repeated if the actor has the ticket already; conflict if another has it or it is resolved.
* note: noted; a note changes nothing.
* resolve: resolved; of a resolved ticket repeated if the content is the same by its digest, whoever sends it, else conflict. A ticket that
  nobody has claimed goes to its resolver, or is refused if ``claim_first`` asks for a claim.

Anything else, and any event of a ticket that isn't there yet, is not_found. So sending any event again changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

VERDICTS = "event_id long, ticket_id long, action string, verdict string"
_STATE = "created boolean, assignee string, digest string"


def digest(resolution: Column) -> Column:
    """What tells one resolution's content from another's; null counts as empty."""
    return F.sha2(F.coalesce(resolution, F.lit("")), 256)


def _placed(events: DataFrame, claim_first: bool) -> DataFrame:
    """Events with the first events that took effect on their ticket: born, claim and solved, each (seq, event_id, actor, digest).

    Each is a least value by ticket, partly aggregated before it is shuffled, so a ticket with very many events is no hot task.
    """
    rows = events.withColumn("digest", digest(F.col("resolution"))).withColumn("at", F.struct("seq", "event_id", "actor", "digest"))

    def first(held: DataFrame, name: str, cond: Column) -> DataFrame:
        found = held.where(cond).groupBy("ticket_id").agg(F.min("at").alias(name))
        return held.join(found, "ticket_id", "left")

    after = lambda name: F.col("at") > F.col(name)
    rows = first(rows, "born", F.col("action") == "create")
    if claim_first:
        rows = first(rows, "claim", (F.col("action") == "claim") & after("born"))
        return first(rows, "solved", (F.col("action") == "resolve") & after("claim"))
    rows = first(rows, "solved", (F.col("action") == "resolve") & after("born"))
    return first(rows, "claim", (F.col("action") == "claim") & after("born") & (F.col("solved").isNull() | (F.col("at") < F.col("solved"))))


def handoff_verdicts(events: DataFrame, claim_first: bool = False) -> DataFrame:
    """VERDICTS of each event."""
    rows, at = _placed(events, claim_first), F.col("at")
    action, is_there = F.col("action"), F.coalesce(at > F.col("born"), F.lit(False))
    solved_before = F.coalesce(at > F.col("solved"), F.lit(False))
    verdict = (
        F.when((action == "create") & (at == F.col("born")), "created").when(~is_there, "not_found").when(action == "create", "repeated").when(action == "note", "noted")
        .when((action == "claim") & (at == F.col("claim")), "claimed")
        .when((action == "claim") & ~solved_before & F.col("claim.actor").eqNullSafe(F.col("actor")), "repeated").when(action == "claim", "conflict")
        .when((action == "resolve") & (at == F.col("solved")), "resolved")
        .when((action == "resolve") & solved_before & (F.col("solved.digest") == F.col("digest")), "repeated").when((action == "resolve") & solved_before, "conflict")
        .when(action == "resolve", "refused").otherwise("not_found")
    )
    return rows.select("event_id", "ticket_id", "action", verdict.alias("verdict"))


def handoff_tickets(events: DataFrame, claim_first: bool = False) -> DataFrame:
    """(ticket_id, status, assignee, resolved_by, digest) of each ticket that was created."""
    rows = _placed(events, claim_first).where("born is not null").groupBy("ticket_id").agg(F.first("claim", True).alias("claim"), F.first("solved", True).alias("solved"))
    status = F.when(F.col("solved").isNotNull(), "resolved").when(F.col("claim").isNotNull(), "claimed").otherwise("pending")
    return rows.select("ticket_id", status.alias("status"), F.coalesce("claim.actor", "solved.actor").alias("assignee"), F.col("solved.actor").alias("resolved_by"), F.col("solved.digest").alias("digest"))


class _Board(StatefulProcessor):
    """One ticket: whether it is there, who has it and the digest of its resolution."""

    def __init__(self, claim_first: bool):
        self.claim_first = claim_first

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ticket = handle.getValueState("ticket", _STATE)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        created, assignee, solved = self.ticket.get() if self.ticket.exists() else (False, None, None)
        batch = pd.concat(list(rows)).sort_values(["seq", "event_id"])
        verdicts = []
        for action, actor, content in zip(batch["action"], batch["actor"], batch["digest"], strict=True):
            if action == "create":
                verdict, created = "repeated" if created else "created", True
            elif not created or action not in ("claim", "note", "resolve"):
                verdict = "not_found"
            elif action == "note":
                verdict = "noted"
            elif action == "claim" and solved is None and assignee is None:
                verdict, assignee = "claimed", actor
            elif action == "claim":
                verdict = "repeated" if solved is None and assignee == actor else "conflict"
            elif solved is not None:
                verdict = "repeated" if solved == content else "conflict"
            elif self.claim_first and assignee is None:
                verdict = "refused"
            else:
                verdict, solved, assignee = "resolved", content, assignee or actor
            verdicts.append(verdict)
        self.ticket.update((created, assignee, solved))
        yield pd.DataFrame({"event_id": batch["event_id"], "ticket_id": batch["ticket_id"], "action": batch["action"], "verdict": verdicts})

    def close(self) -> None:
        pass


def handoff_stream(events: DataFrame, claim_first: bool = False) -> DataFrame:
    """The same on a stream of events, decided in the order in which they come. It needs the RocksDB state store."""
    rows = events.withColumn("digest", digest(F.col("resolution"))).drop("resolution")
    return rows.groupBy("ticket_id").transformWithStateInPandas(statefulProcessor=_Board(claim_first), outputStructType=VERDICTS, outputMode="append", timeMode="None")
