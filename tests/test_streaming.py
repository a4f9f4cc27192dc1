"""The event operators on a stream against their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.streaming import windows

SF = "/root/testdata/sf0.001"


def stream_of(spark, tmp_path, files: int = 3):
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(files).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), events


def drained(spark, df, name, tmp_path, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name)


def test_rate_in_complete_mode(spark, tmp_path):
    stream, events = stream_of(spark, tmp_path)
    found = drained(spark, windows.rate(stream), "rates", tmp_path, "complete").select("start", "event_type", "n")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, windows.rate(events).select("start", "event_type", "n").collect()))


def test_repeats_within_the_watermark_go(spark, tmp_path):
    stream, events = stream_of(spark, tmp_path)
    twice = stream.union(stream)
    assert drained(spark, windows.first_of_each(twice, "60 days"), "once", tmp_path).count() == events.count()


def test_late_events_are_dropped_and_windows_close(spark, tmp_path):
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    folder = str(tmp_path / "in")
    rows = lambda *r: spark.createDataFrame(list(r), "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(folder)
    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
        closed = windows.rate(stream.withWatermark("ts", "10 minutes"))
        query = closed.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(120)

    rows((1, "2024-01-01 00:01:00", 1, "a", 1.0))
    run()
    rows((2, "2024-01-01 01:00:00", 1, "a", 1.0))
    run()
    rows((3, "2024-01-01 00:02:00", 1, "a", 1.0), (4, "2024-01-01 02:00:00", 1, "a", 1.0))
    run()
    found = spark.read.parquet(str(tmp_path / "out"))
    assert [(str(r["start"]), r["n"]) for r in found.orderBy("start").collect()] == [("2024-01-01 00:00:00", 1), ("2024-01-01 01:00:00", 1)]


def test_limit_with_state(spark, tmp_path):
    stream, events = stream_of(spark, tmp_path, files=1)
    found = drained(spark, windows.limit_stream(stream.select("event_id", "user_id", "ts"), 7200, 1), "limited", tmp_path)
    batch = windows.sliding_limit_stateful(events, 7200, 1)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, batch.collect()))
