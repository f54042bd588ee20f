"""The store's tables after batches, replays and a crash between two writes."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cairnbook.operators import ingest

SCHEMA = "source_id string, account_id string, native_id string, content_hash string, body string, seq int"
AT = "2026-01-01"


def state(spark, path):
    return {t: sorted(map(str, ingest.read_table(spark, path, t).collect())) for t in ingest.SCHEMAS}


def items(spark, rows):
    return spark.createDataFrame([(s, a, n, h, f"body {h}", q) for s, a, n, h, q in rows], SCHEMA)


FIRST = [("s", None, "b", "1", 0), ("s", None, "a", "1", 0), ("s", "x", "a", "2", 0), (None, None, None, "3", 0), ("s", None, "a", "1", 1)]
SECOND = [("s", None, "a", "1", 0), ("s", None, "b", "9", 0), ("s", None, "b", "8", 1), ("t", None, "c", "4", 0), ("t", None, "c", "5", 1)]


def test_batches_replays_and_ids(spark, tmp_path):
    path = str(tmp_path / "store")
    one = ingest.ingest_batch(spark, path, items(spark, FIRST), 1, AT)
    assert (one["created"], one["versioned"], one["unchanged"], one["high_water"]) == (4, 0, 1, 4)
    two = ingest.ingest_batch(spark, path, items(spark, SECOND), 2, AT)
    assert (two["created"], two["versioned"], two["unchanged"], two["high_water"]) == (1, 3, 1, 5)
    before = state(spark, path)
    assert ingest.ingest_batch(spark, path, items(spark, SECOND), 2, AT)["versioned"] == 3
    assert state(spark, path) == before
    again = ingest.ingest_batch(spark, path, items(spark, [SECOND[2], SECOND[4]]), 3, AT)
    assert (again["created"], again["versioned"], again["unchanged"]) == (0, 0, 2)
    heads = {(r["source_id"], r["account_id"], r["native_id"]): (r["object_id"], r["content_hash"], r["version_num"]) for r in ingest.read_table(spark, path, "source_object").collect()}
    assert heads[("s", None, "b")][1:] == ("8", 3) and heads[("t", None, "c")] == ("KB-00000005", "5", 2)
    versions = {r["version_id"]: r["parent_version_id"] for r in ingest.read_table(spark, path, "object_version").collect()}
    assert len(versions) == 8 and versions[f"{heads[('s', None, 'b')][0]}:v03"] == f"{heads[('s', None, 'b')][0]}:v02"
    assert ingest.read_table(spark, path, "provenance").count() == ingest.read_table(spark, path, "event").count() == 8


def test_empty_batch_and_store(spark, tmp_path):
    path = str(tmp_path / "store")
    assert all(not rows for rows in state(spark, path).values())
    assert ingest.ingest_batch(spark, path, items(spark, []), 1, AT)["created"] == 0


def test_visits_count_once(spark, tmp_path):
    path = str(tmp_path / "store")
    v = spark.createDataFrame([("u", "d", "t"), ("u", "d", None), (None, None, "x")], "normalized_url string, domain string, title string").withColumn("ts", F.lit(AT).cast("timestamp"))
    for batch in (1, 2):
        ingest.ingest_batch(spark, path, items(spark, []), batch, AT, visits=v)
    assert [r["title"] for r in ingest.read_table(spark, path, "visit").collect()] == ["t"]


def test_stream_that_stops_between_two_writes(spark, tmp_path, monkeypatch):
    """Readers see the batch that died not at all; the next start finishes it, and the result is that of one that never
    stopped."""
    folder, good, torn = (str(tmp_path / n) for n in ("in", "good", "torn"))
    write, calls = ingest.write_table, []

    def feed(path, name):
        live = spark.readStream.schema(SCHEMA).parquet(folder)
        return ingest.ingest_stream(live, path, str(tmp_path / name), AT, lambda df: df)

    items(spark, FIRST).coalesce(1).write.parquet(folder)
    for path in (good, torn):
        assert feed(path, f"cp-{path[-4:]}").awaitTermination(180)
    items(spark, SECOND).coalesce(1).write.mode("append").parquet(folder)
    assert feed(good, "cp-good").awaitTermination(180)

    def dies(rows, table, path):
        calls.append(table)
        if len(calls) == 3:
            raise RuntimeError("the machine went away")
        write(rows, table, path)

    before = state(spark, torn)
    monkeypatch.setattr(ingest, "write_table", dies)
    with pytest.raises(Exception, match="the machine went away"):
        feed(torn, "cp-torn").awaitTermination(180)
    assert len(calls) == 3 and state(spark, torn) == before
    monkeypatch.setattr(ingest, "write_table", write)
    assert feed(torn, "cp-torn").awaitTermination(180)
    assert state(spark, torn) == state(spark, good) != before
