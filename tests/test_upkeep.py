"""Redaction as history, mirrors, walks of two steps, sidecars and memory files of odd shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnbook.functions import text as tx
from cairnbook.operators import graph, secretscan, sinks
from cairnbook.sources import assistant


def test_redaction_twice_changes_once(spark):
    rows = [("o1", 1, 'token = "0123456789abcdef0"', "PRIVATE"), ("o2", 3, "nothing", "PRIVATE"), ("o3", 1, None, "PRIVATE")]
    objects = spark.createDataFrame(rows, "object_id string, version_num int, body string, classification string")
    indexes = spark.createDataFrame([("fts", "FRESH")], "index_name string, status string")
    one = secretscan.redact_objects(objects, indexes, "2026-01-01")
    assert sorted(map(str, one["objects"].collect())) == sorted(map(str, objects.filter("object_id <> 'o1'").collect() + spark.createDataFrame([("o1", 2, "[REDACTED:token_assignment]", "RESTRICTED")], objects.schema).collect()))
    assert [r["version_id"] for r in one["versions"].collect()] == ["o1:v02"] and [r["status"] for r in one["indexes"].collect()] == ["STALE"]
    two = secretscan.redact_objects(one["objects"], indexes, "2026-01-02")
    assert two["versions"].isEmpty() and two["events"].isEmpty() and [r["status"] for r in two["indexes"].collect()] == ["FRESH"]


def test_mirror_counts_while_it_writes(spark, tmp_path):
    rows = spark.createDataFrame([(3, "ü"), (1, None), (2, "x")], "a int, b string")
    got = {r["table"]: (r["n_rows"], r["bytes"]) for r in sinks.export_mirror({"t": rows, "none": rows.limit(0)}, str(tmp_path)).collect()}
    lines = [x for f in sorted((tmp_path / "t").glob("part-*")) for x in f.read_text().splitlines()]
    assert lines == ['{"a":1,"b":null}', '{"a":2,"b":"x"}', '{"a":3,"b":"ü"}']
    assert got == {"t": (3, sum(len(x.encode()) + 1 for x in lines)), "none": (0, 0)}


def test_second_degree(spark):
    edges = [("a", "b"), ("b", "c"), ("a", "d"), ("d", "c"), ("c", "e"), ("a", "a"), ("b", "a")] + [(f"n{k}", "hub") for k in range(50)]
    df = spark.createDataFrame(edges, "source_object string, target_object string")
    got = {(r["object_id"], r["second"]): r["paths"] for r in graph.second_degree(df).collect()}
    assert got[("a", "c")] == 2 and got[("c", "a")] == 2 and got[("b", "e")] == 1 and ("a", "b") not in got and ("a", "a") not in got
    hub = [k for k in got if k[0].startswith("n")]
    assert len(hub) <= 50 * 20 and all(k[1].startswith("n") for k in hub)
    assert graph.second_degree(df, limit=1).groupBy("object_id").count().agg(F.max("count")).first()[0] == 1


def test_memory_of_another_account_is_not_read(spark):
    ours, theirs = "0a1b2c3d-0000-4000-8000-00000000000a", "ffffffff-0000-4000-8000-00000000000b"
    files = [(f"m/{theirs}.json", '{"story":"theirs"}'), ("m/loose.json", '{"story":"loose"}')]
    schema = "path string, text string"
    items, foreign = assistant.scan_memory(spark.createDataFrame(files, schema), ours)
    assert [r["body"] for r in items.collect()] == ["loose"] and foreign.count() == 1
    items, _ = assistant.scan_memory(spark.createDataFrame([*files, (f"m/{ours}.json", '[{"story":" "},{"map":{"k":[1,2],"e":null}}]')], schema), ours)
    assert [(r["native_id"], r["body"]) for r in items.collect()] == [("memory:map/k:1", "[1,2]")]
    items, foreign = assistant.scan_memory(spark.createDataFrame([], schema), ours)
    assert items.collect() == foreign.collect() == []


def test_databases_and_values(spark):
    files = [("a.csv", "x,y\n1,2\n"), ("b.csv", ""), ("c.csv", None), ("d.csv", '"p\nq",r\r\n"1\n2",3\r\n\r\n')]
    got = {r["native_id"]: r["raw_metadata"] for r in assistant.scan_databases(spark.createDataFrame(files, "path string, text string")).collect()}
    assert got["database:a.csv"] == '{"row_count":1,"columns":["x","y"]}' and '"row_count":0' in got["database:b.csv"]
    assert got["database:d.csv"] == '{"row_count":1,"columns":["p\\nq","r"]}'
    values = ['[1,[2,[3,[4,[5]]]]]', '{"name":"","email":"e"}', "null", "true", '"s"', None]
    out = spark.createDataFrame(list(enumerate(values)), "i int, v string").select("i", tx.flat_value(F.try_parse_json("v")).alias("f")).orderBy("i").collect()
    assert [r["f"] for r in out] == ["1, 2, 3, 4, [5]", "e", None, "true", "s", None]


def test_calendars_and_canvases_of_odd_shapes(spark):
    from cairnbook.sources import records

    files = [("a", "BEGIN:VEVENT\nSUMMARY:x\\\\n\\;y\nDTSTART;TZID=A/B:20260101T000000\nEND:VEVENT\nBEGIN:VEVENT\nEND:VEVENT"), ("b", ""), ("c", None)]
    got = [(r["path"], r["n"], r["summary"], r["starts"], r["uid"]) for r in records.calendar_events(spark.createDataFrame(files, "path string, text string")).orderBy("n").collect()]
    assert got == [("a", 0, "x\\n;y", "20260101T000000", None), ("a", 1, None, None, None)]
    nodes, edges = records.scan_canvas(spark.createDataFrame([("a", '{"nodes":[{"id":"1","type":"group","label":"g"}]}'), ("b", "broken"), ("c", None)], "path string, text string"))
    assert [(r["node"], r["text"]) for r in nodes.collect()] == [("1", "g")] and edges.collect() == []


def test_ids_sort_by_number(spark):
    from cairnbook.operators import dedupe, replication

    ids = ["KB-100000000", "KB-99999999"]
    rows = spark.createDataFrame([(i, "h", 1, None) for i in ids], "object_id string, content_hash string, bytes int, is_duplicate_of string")
    assert dedupe.exact_duplicates(rows).first()["canonical"] == "KB-99999999"
    m = replication.store_manifest(rows.select("object_id", F.col("object_id").alias("uuid")), rows)
    assert (m.first()["lineage"], m.first()["high_water"]) == ("KB-99999999", "KB-100000000")
    old = m.withColumn("high_water", F.lit("KB-99999999"))
    assert [r["refusal"] for r in replication.refusals(old, m).collect()] == ["remote is ahead"] and replication.refusals(m, old).isEmpty()
