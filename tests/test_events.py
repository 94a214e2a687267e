from datetime import datetime, timedelta

from pyspark.sql import functions as F

from codesift.operators import events
from codesift.streaming import events as streams
from codesift.streaming.memory import remembered

T = datetime(2025, 1, 1)


def test_time_limit_runs_from_the_opening_delivery(spark, rows):
    hours = [(1, "a", 0), (2, "a", 23), (3, "a", 25), (4, "a", 48), (5, "a", 50), (6, None, 0), (7, None, 1), (8, "b", 30)]
    df = spark.createDataFrame([(i, k, T + timedelta(hours=h)) for i, k, h in hours], "id BIGINT, k STRING, at TIMESTAMP")
    assert rows(events.within_limit(df, "k", "at", "id")) == [(1,), (3,), (5,), (6,), (7,), (8,)]
    assert events.within_limit(df.limit(0), "k", "at", "id").count() == 0


def test_attempts(spark, rows):
    df = spark.createDataFrame([(i, "k", T + timedelta(seconds=i)) for i in range(5)], "id BIGINT, k STRING, at TIMESTAMP")
    assert rows(events.attempt_schedule(df, "k", "at", "id"), "id", "wait_s", "total_s", "dead")[:4] == [(0, 30, 30, False), (1, 60, 90, False), (2, 120, 210, False), (3, None, 210, True)]


def test_histogram_bounds_are_inclusive(spark):
    df = spark.createDataFrame([("a", v) for v in (5.0, 5.1, 600.0, 601.0, None)], "k STRING, v DOUBLE")
    got = {r["le"]: r["count"] for r in events.histogram(df, ["k"], "v").collect()}
    assert got[5.0] == 1 and got[10.0] == 2 and got[600.0] == 3 and got[None] == 4


def test_in_flight(spark, rows):
    df = spark.createDataFrame([("a", T, T + timedelta(10)), ("a", T + timedelta(5), None), ("a", T + timedelta(10), T + timedelta(11))], "k STRING, s TIMESTAMP, e TIMESTAMP")
    assert rows(events.in_flight(df, ["k"], "s", "e")) == [("a", 2, T + timedelta(5))]


def test_error_class(spark):
    df = spark.createDataFrame([("Timeout: x: y",), ("plain",), (None,), ("",)], "e STRING")
    assert [r[0] for r in df.select(events.error_class(df.e)).collect()] == ["Timeout", "plain", "unknown", "unknown"]


def test_stream_equals_batch(spark, tmp_path, rows):
    data = [(i, T + timedelta(minutes=i * 7), i % 5, "view" if i % 2 else "error", float(i), "{}") for i in range(200)]
    df = spark.createDataFrame(data, "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, props STRING").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df.unionByName(df.limit(20)).repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    read = streams.read_table(spark, str(tmp_path), "events", streams.EVENTS, files=1)
    once = streams.run_to_end(streams.first_within(read, ["event_id"]), "t", "append")
    assert once.count() == once.select("event_id").distinct().count() <= 200
    read = streams.read_table(spark, str(tmp_path), "events", streams.EVENTS, files=1)
    live = streams.run_to_end(events.per_window(streams.timed(read, "1 hour"), "ts", "1 hour", None, ["event_type"]), "w", "complete")
    batch = events.per_window(spark.read.parquet(str(tmp_path / "events.parquet")).withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 hour", None, ["event_type"])
    assert rows(live) == rows(batch)


def test_remembered_state(spark, tmp_path):
    df = spark.createDataFrame([("a", "1", T), ("a", "2", T + timedelta(seconds=1)), ("b", "3", T)], "key STRING, value STRING, ts TIMESTAMP")
    df.coalesce(1).write.parquet(str(tmp_path / "kv"))
    stream = remembered(spark.readStream.schema(df.schema).parquet(str(tmp_path / "kv")))
    got = {r["key"]: (r["value"], r["writes"]) for r in streams.run_to_end(stream, "kv", "update", timers=True).collect()}
    assert got == {"a": ("2", 2), "b": ("3", 1)}
