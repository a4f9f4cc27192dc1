"""Handoff tickets in batch against a stream, checked cases, and an archive that is copied once."""

from __future__ import annotations

import random

import pytest

from tessera.operators import handoffs
from tessera.sources import archive, cases
from tests.test_streaming import drained

EVENTS = "event_id long, seq long, ticket_id long, action string, actor string, resolution string"


def verdicts(df) -> dict:
    return {r["event_id"]: r["verdict"] for r in df.collect()}


def test_first_claim_and_equal_resolutions(spark):
    rows = [
        (1, 1, 7, "claim", "a", None), (2, 2, 7, "create", None, None), (3, 3, 7, "claim", "a", None), (4, 4, 7, "claim", "a", None), (5, 5, 7, "claim", "b", None), (6, 6, 7, "note", "b", None),
        (7, 7, 7, "resolve", "b", "x"), (8, 8, 7, "resolve", "a", "x"), (9, 9, 7, "resolve", "b", "y"), (10, 10, 7, "claim", "a", None), (11, 11, 7, "create", None, None), (12, 12, 7, "dance", "a", None),
        (13, 1, 8, "create", None, None), (14, 2, 8, "resolve", "c", None), (15, 3, 8, "resolve", "d", ""), (16, 4, 8, "claim", "c", None),
    ]
    events = spark.createDataFrame(rows, EVENTS)
    found = verdicts(handoffs.handoff_verdicts(events))
    assert [found[i] for i in range(1, 17)] == "not_found created claimed repeated conflict noted resolved repeated conflict conflict repeated not_found created resolved repeated conflict".split()
    assert [verdicts(handoffs.handoff_verdicts(events, claim_first=True))[i] for i in (14, 15, 16)] == ["refused", "refused", "claimed"]
    tickets = {r["ticket_id"]: (r["status"], r["assignee"], r["resolved_by"]) for r in handoffs.handoff_tickets(events).collect()}
    assert tickets == {7: ("resolved", "a", "b"), 8: ("resolved", "c", "c")}


@pytest.mark.parametrize("claim_first", [False, True])
def test_ticket_stream_equals_batch_and_replays_change_nothing(spark, tmp_path, claim_first):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rng = random.Random(5)
    rows = [(i, i, rng.randrange(12), rng.choice(["create", "claim", "note", "resolve"]), rng.choice("ab"), rng.choice(["x", "y", None])) for i in range(160)]
    # Every event comes a second time, later.
    rows += [(1000 + i, 1000 + i, *r[2:]) for i, r in enumerate(rows)]
    for part in range(4):
        spark.createDataFrame(rows[part * 80 : part * 80 + 80], EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    events = spark.createDataFrame(rows, EVENTS)
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    name = f"tickets_{claim_first}".lower()
    found = verdicts(drained(spark, handoffs.handoff_stream(stream, claim_first), name, tmp_path))
    assert found == verdicts(handoffs.handoff_verdicts(events, claim_first))
    took = {"created", "claimed", "resolved"}
    again = {r[0]: r for r in rows}
    for i in range(160):
        if found[i] in took:
            assert found[1000 + i] not in took, again[i]
    assert handoffs.handoff_tickets(spark.createDataFrame([], EVENTS)).count() == 0


def test_every_wrong_case_is_named(spark, tmp_path):
    good = '{"id":"a","query":"q","expected":["x"],"k":2,"tags":["t"]}'
    wrong = {
        "not_object": "[1]", "missing_field": '{"id":"b","query":"r"}', "bad_id": '{"id":" ","query":"r","expected":[]}', "duplicate_id": '{"id":"a","query":"r2","expected":[]}', "bad_query": '{"id":"d","query":5,"expected":[]}',
        "duplicate_query": '{"id":"e","query":" q ","expected":[]}', "bad_expected": '{"id":"f","query":"s","expected":["x",""]}', "duplicate_expected": '{"id":"g","query":"t","expected":["x","x"]}',
        "bad_k": '{"id":"h","query":"u","expected":[],"k":1.5}', "bad_tags": '{"id":"i","query":"v","expected":[],"tags":["t","t"]}',
    }
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.json").write_text('{"cases": [%s, {"id":"z","query":"zz","expected":[]}]}' % good)
    (tmp_path / "sub" / "b.json").write_text('{"cases": [%s]}' % ",\n".join(wrong.values()))
    (tmp_path / "c.json").write_text("{not json")
    (tmp_path / "d.json").write_text('{"cases": {}}')
    (tmp_path / "e.json").write_text("[]")
    (tmp_path / "f.json").write_text('{"cases": []}')
    (tmp_path / "g.json").write_text('{"cases": [{"id":"k1","query":"k1","expected":[],"k":true},{"id":"k2","query":"k2","expected":[],"k":0},{"id":"k3","query":"k3","expected":null},null]}')
    found, bad = cases.scan_retrieval_cases(spark, str(tmp_path))
    assert sorted((r["id"], r["query"], r["expected"], r["k"], r["tags"]) for r in found.collect()) == [("a", "q", ["x"], 2, ["t"]), ("z", "zz", [], 5, [])]
    rows = sorted((r["path"].rsplit("/", 1)[-1], r["place"] if r["place"] is not None else -1, r["error"]) for r in bad.collect())
    assert [e for f, _, e in rows if f == "b.json"] == list(wrong)
    assert [r for r in rows if r[0] in ("c.json", "d.json", "e.json", "f.json")] == [("c.json", -1, "not_json"), ("d.json", -1, "no_cases"), ("e.json", -1, "no_cases")]
    assert [e for f, _, e in rows if f == "g.json"] == ["bad_k", "bad_k", "bad_expected", "not_object"]


def test_archive_is_copied_once_over_a_crash(spark, tmp_path, monkeypatch):
    source, target, state = (str(tmp_path / n) for n in ("turns", "out", "state"))

    def put(name: str, text: str):
        (tmp_path / "turns" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "turns" / name).write_text(text)

    def run():
        archive.sync_archive(archive.archive_files(spark, source, 2), target, state).trigger(availableNow=True).start().awaitTermination(120)

    for i in range(4):
        put(f"20240102/{i}.json", f'{{"n": {i}}}')
    run()
    # The next batch is written, but its commit fails; a file with an older date comes late.
    put("20240101/late.json", "{}")
    put("20240103/9.json", "{}")
    write = archive.copy_batch

    def fails(*args):
        write(*args)
        raise RuntimeError("lost")

    monkeypatch.setattr(archive, "copy_batch", fails)
    with pytest.raises(Exception, match="lost"):
        run()
    monkeypatch.setattr(archive, "copy_batch", write)
    put("20240104/1.json", "[]")
    run()
    run()
    rows = archive.archived(spark, target).collect()
    assert sorted(r["key"] for r in rows) == ["20240101/late.json", *(f"20240102/{i}.json" for i in range(4)), "20240103/9.json", "20240104/1.json"]
    assert max(r["cursor"] for r in rows) == "20240104/1.json" and {r["key"]: r["content"] for r in rows}["20240102/3.json"] == '{"n": 3}'
    archive.copy_batch(spark.createDataFrame([("20240103/9.json", "other"), ("20240105/0.json", "b"), ("20240105/0.json", "a")], "key string, content string"), 99, target)
    again = archive.archived(spark, target).where("batch = 99").collect()
    assert [(r["key"], r["content"], r["cursor"]) for r in again] == [("20240105/0.json", "a", "20240105/0.json")]
    assert archive.archived(spark, str(tmp_path / "none")).count() == 0
