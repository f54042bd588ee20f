"""Streams give what the batch forms give."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cairnbook.streaming import streams

SCHEMA = "event_id long, user_id long, event_type string, value double, ts timestamp"


@pytest.fixture(scope="module")
def events(spark):
    rows = [(k, f"2024-01-0{1 + k % 3} 10:00:00", k % 2, "view", 1.0) for k in range(12)]
    return spark.createDataFrame(rows, "event_id long, t string, user_id long, event_type string, value double").select("*", F.to_timestamp("t").alias("ts")).drop("t")


@pytest.fixture
def folder(events, tmp_path):
    events.union(events).coalesce(1).write.parquet(str(tmp_path / "in"))
    return str(tmp_path / "in")


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_replayed_events_are_dropped(spark, folder):
    live = spark.readStream.schema(SCHEMA).parquet(folder)
    assert run(streams.dedup_stream(live, watermark="10 days"), "replay").count() == 12


def test_windows_of_a_replayed_log(spark, folder, events):
    live = spark.readStream.schema(SCHEMA).parquet(folder)
    got = run(streams.windowed_counts(streams.dedup_stream(live, watermark="1 hour"), watermark=None), "windows")
    # a window is emitted once the watermark has passed its end: the last day's stays open
    want = streams.windowed_counts(streams.dedup_stream(events.union(events)))
    assert sorted(got.collect()) == sorted(want.orderBy("window_start").limit(2).collect())
    assert want.agg(F.sum("n")).first()[0] == 12


def test_sessions(spark, folder, events):
    live = spark.readStream.schema(SCHEMA).parquet(folder)
    got = run(streams.activity_sessions(live, "2 hours"), "sessions")
    assert got.agg(F.sum("n")).first()[0] == 16  # two of three days; copies count
    assert streams.activity_sessions(events, "30 hours").count() == 2


def test_ingestion_resumes(spark, folder, events, tmp_path):
    seen: list[int] = []

    def once():
        streams.stream_ingest(spark, folder, SCHEMA, str(tmp_path / "cp"), lambda df, k: seen.append(df.count())).awaitTermination(120)

    once()
    once()
    events.limit(5).write.mode("append").parquet(folder)
    once()
    assert seen == [24, 5]


def test_late_rows(spark, events):
    mark = spark.sql("select timestamp'2024-01-02 00:00:00' as watermark")
    late_too = events.union(events.limit(1).withColumn("ts", F.lit(None).cast("timestamp")))
    ontime, late = streams.late_rows(late_too, mark)
    assert (ontime.count(), late.count()) == (8, 5)


def test_late_rows_go_to_dead_letters(spark, events, tmp_path):
    path, took = str(tmp_path / "log"), []

    def feed(day):
        events.filter(F.dayofmonth("ts") == day).write.mode("append").parquet(path)
        live = spark.readStream.schema(SCHEMA).parquet(path)
        streams.quarantine_late(live, str(tmp_path / "dead"), str(tmp_path / "cp"), lambda df, k: took.append(df.count()), "1 day").awaitTermination(120)

    feed(3)
    feed(1)
    feed(2)
    assert took == [4, 0, 4]
    assert spark.read.parquet(str(tmp_path / "dead")).count() == 4
