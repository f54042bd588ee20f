"""Operators on small tables with known outcomes, and the invariants that they keep."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from cairnbook.operators import canonical, dedupe, graph, insight, provenance, replication, search, secretscan, sinks, validate


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_ingest_created_versioned_unchanged(spark):
    have = spark.createDataFrame([("s", None, "a", "KB-00000001", "h1", 1), ("s", "x", "b", "KB-00000002", "h2", 3)], "source_id string, account_id string, native_id string, object_id string, content_hash string, version_num int")
    items = spark.createDataFrame(
        [("s", None, "a", "h1", 0), ("s", "x", "b", "h9", 1), ("s", None, "b", "h2", 2), ("s", None, "b", "h2", 3), ("s", None, "b", "h5", 4)],
        "source_id string, account_id string, native_id string, content_hash string, seq int",
    )
    out = canonical.ingest_outcomes(items, have)
    assert rows(out, "seq", "outcome", "new_version") == [(0, "unchanged", 1), (1, "versioned", 4), (2, "created", 1), (3, "unchanged", 1), (4, "versioned", 2)]
    current, versions = canonical.apply_outcomes(out, have, 2)
    assert current.count() == 3 and versions.count() == 3
    again = canonical.ingest_outcomes(items.groupBy("source_id", "account_id", "native_id").agg(F.max_by("content_hash", "seq").alias("content_hash")).withColumn("seq", F.lit(0)), current)
    assert {r["outcome"] for r in again.collect()} == {"unchanged"}


def test_ids_are_dense(spark):
    ids = canonical.allocate_ids(spark.range(100).select(F.format_string("k%03d", "id").alias("k")), "k", 7, 5)
    assert [r["object_id"] for r in ids.orderBy("k").collect()] == [f"KB-{n:08d}" for n in range(8, 108)]


def test_duplicates_link_and_never_delete(spark):
    o = spark.createDataFrame([("KB-3", "h", 5), ("KB-1", "h", 5), ("KB-2", "g", 7), ("KB-4", None, 1)], "object_id string, content_hash string, bytes long").withColumn("is_duplicate_of", F.lit(None).cast("string"))
    links = dedupe.link_duplicates(o)
    assert rows(links, "alias", "canonical") == [("KB-3", "KB-1")]
    after = dedupe.with_aliases(o, links)
    assert after.count() == 4 and dedupe.exact_duplicates(after).count() == 0
    assert tuple(dedupe.reclaimable(dedupe.exact_duplicates(o)).first()) == (1, 1, 5)


def test_wikilinks_resolve_by_path_name_and_stem(spark):
    files = spark.createDataFrame([("a/x.md",), ("b/x.md",), ("b/y.md",)], "path string")
    links = spark.createDataFrame([("s", "y"), ("s", "x"), ("s", "a/x"), ("s", "zz")], "source_path string, target string")
    assert rows(canonical.resolve_wikilinks(links, files), "target", "status") == [("a/x", "OK"), ("x", "AMBIGUOUS"), ("y", "OK"), ("zz", "MISSING")]


def test_graph_retire_merge_rebuild(spark):
    edges = spark.createDataFrame([("o1", "e1", "M", "rule:x"), ("o2", "e2", "M", "human")], "source_object string, target_object string, relationship_type string, created_by string")
    entities = spark.createDataFrame([("e1", "SUPERSEDED", None), ("e3", "CURRENT", None), ("e4", "CURRENT", "e1")], "object_id string, decay_status string, is_duplicate_of string")
    assert rows(graph.retire_orphans(entities, edges), "object_id", "decay_status") == [("e1", "CURRENT"), ("e3", "SUPERSEDED"), ("e4", "CURRENT")]
    decisions = spark.createDataFrame([("e1", "e2", "me"), ("e1", "e9", None)], "canonical string, alias string, confirmed_by string")
    merged, good = graph.merge_entities(edges, decisions)
    assert rows(merged, "source_object", "target_object") == [("o1", "e1"), ("o2", "e1")] and good.count() == 1
    assert graph.rebuild_edges(edges, edges.filter("false")).count() == 1


def test_mentions_saturate(spark):
    docs = spark.createDataFrame([(f"o{i}", "alpha beta gamma" if i < 3 else "beta only here") for i in range(40)], "object_id string, body string")
    titles = spark.createDataFrame([("alpha beta",), ("only here",), ("abc",)], "title string")
    got = graph.mentions(docs, titles, saturation=0.1)
    assert rows(got.filter("title = 'alpha beta'"), "object_id") == [("o0",), ("o1",), ("o2",)]
    assert rows(got.filter("title = 'only here'"), "object_id") == [(None,)] and got.filter("title = 'abc'").count() == 0


def test_search_expands_and_switches(spark):
    docs = [("d1", "kelp harvest season coast"), ("d2", "kelp harvest boats coast"), ("d3", "harvest boats and season moon")] + [(f"f{i}", f"filler text number words{i}") for i in range(16)]
    o = spark.createDataFrame(docs, "object_id string, body string").withColumns({"authority": F.lit("UNKNOWN"), "modified_at": F.lit(None).cast("timestamp")})
    q = spark.createDataFrame([(1, "kelp")], "query_id int, query string")
    wide, narrow = search.search(o, q), search.search(o, q, expand=False)
    assert "d3" in {r["object_id"] for r in wide.collect()} and {r["object_id"] for r in narrow.collect()} == {"d1", "d2"}


def test_provenance_and_citation(spark):
    o = spark.createDataFrame([("a", "a:v01"), ("b", "b:v01"), ("c", None)], "object_id string, current_version_id string")
    v = spark.createDataFrame([("a:v01", "h"), ("b:v01", "g")], "version_id string, content_hash string")
    p = spark.createDataFrame([(1, "a:v01", "s", "old"), (2, "a:v01", "s", "h"), (3, "b:v01", "s", "gone")], "provenance_id int, version_id string, source_object_id string, evidence_hash string")
    chain = provenance.provenance_chain(o, v, p, spark.createDataFrame([("h",)], "content_hash string"))
    assert chain.count() == 3
    assert rows(chain, "object_id", "complete") == [("a", True), ("b", False), ("c", False)]
    e = spark.createDataFrame([("c", "a", "DERIVED_FROM")], "source_object string, target_object string, relationship_type string")
    assert rows(provenance.cite(chain, e), "object_id", "status") == [("a", "COMPLETE"), ("b", "INCOMPLETE"), ("c", "COMPLETE_VIA_PARENTS")]


SECRETS = [
    ("postgres://user:pass@host/db", False), ("key = YOUR_API_KEY", False), ("token = '${TOKEN}'", False), ("a" * 64, False), ("[t](https://x.example/y)", False), ("plain", False),
    ("AKIA" + "ABCDEFGHIJKLMNOP", True), ("postgres://svc:hunter22@db.internal/x", True), ('token = "0123456789abcdef0123"', True),
]


def test_secrets(spark):
    d = spark.createDataFrame(SECRETS, "text string, expect boolean")
    assert d.filter((F.size(secretscan.scan_body(F.col("text"))) > 0) != F.col("expect")).count() == 0
    assert d.filter((F.size(secretscan.scan_spans("text")) > 0) != F.col("expect")).count() == 0
    clean = d.select(secretscan.redact_text(F.col("text")).alias("t"), "text", "expect")
    assert clean.filter((F.col("t") != F.col("text")) != F.col("expect")).count() == 0


def test_a_placeholder_beside_a_secret_hides_nothing(spark):
    d = spark.createDataFrame([("postgres://svc:hunter22@db.internal/x?owner=your_team",), ("postgres://user:pass@db/your_team",), (None,)], "text string")
    got = [r["t"] for r in d.select(secretscan.redact_text(F.col("text")).alias("t")).collect()]
    assert got == ["[REDACTED:connection_string]/x?owner=your_team", "postgres://user:pass@db/your_team", None]


def test_validation(spark):
    v = spark.createDataFrame([("a:v01", None, 1), ("a:v02", "a:v01", 2), ("b:v02", "b:v01", 2), ("c:v02", None, 2)], "version_id string, parent_version_id string, version_num int")
    assert rows(validate.broken_chains(v), "version_id") == [("b:v02",), ("c:v02",)]
    checks = validate.check(validate.broken_chains(v), "chains")
    assert tuple(checks.first()) == ("chains", 2, "ERROR") and validate.passed(checks).first()["passed"] is False


def test_replication(spark):
    side = lambda *x: spark.createDataFrame(list(x), "path string, hash string")
    base = side(("same", "1"), ("l", "1"), ("r", "1"), ("c", "1"), ("ld", "1"), ("rd", "1"))
    local = side(("same", "1"), ("l", "2"), ("r", "1"), ("c", "2"), ("rd", "1"), ("new", "1"))
    remote = side(("same", "1"), ("l", "1"), ("r", "2"), ("c", "3"), ("ld", "1"))
    assert dict(rows(replication.replica_state(local, remote, base), "path", "state")) == {"same": "SAME", "l": "LOCAL_NEWER", "r": "REMOTE_NEWER", "c": "CONFLICT", "ld": "LOCAL_DELETED", "rd": "REMOTE_DELETED", "new": "LOCAL_NEWER"}
    m = lambda x, h: spark.createDataFrame([(x, h)], "lineage string, high_water string")
    assert rows(replication.refusals(m("a", "KB-1"), m("b", "KB-2")), "refusal") == [("other lineage",), ("remote is ahead",)]
    assert replication.refusals(m("a", "KB-1"), m("a", "KB-2"), force=True).count() == 0


def test_insight(spark):
    d = spark.createDataFrame([("2024-01-05",), ("2024-04-01",), (None,)], "t string").select(F.to_timestamp("t").alias("ts"))
    assert rows(insight.months_dark(d, "ts"), "month") == [("2024-02",), ("2024-03",)]
    assert insight.months_dark(d.filter("false"), "ts").count() == 0


def test_sinks(spark, tmp_path):
    files = spark.createDataFrame([(bytearray(b"a"),), (bytearray(b"a"),), (bytearray(b"b"),)], "content binary")
    new = sinks.store_blobs(files, str(tmp_path / "blobs"))
    assert new.count() == new.count() == 2
    again = sinks.store_blobs(files, str(tmp_path / "blobs"), spark.read.parquet(str(tmp_path / "blobs")))
    assert again.count() == again.count() == 0
    assert spark.read.parquet(str(tmp_path / "blobs")).count() == 2
    t = {"t": spark.createDataFrame([(2, None), (1, "x")], "a int, b string")}
    assert sinks.export_mirror(t, str(tmp_path / "mirror")).first()["n_rows"] == 2
    assert [r["value"] for r in spark.read.text(str(tmp_path / "mirror/t")).collect()] == ['{"a":1,"b":"x"}', '{"a":2,"b":null}']
    assert sinks.snapshot(t, str(tmp_path / "snap"), "daily").first()["proven"] is False
    log = spark.createDataFrame([(1, "created")], "event_id int, operation string")
    assert sinks.append_events(log, spark.createDataFrame([(1, "ACQUIRED"), (2, "MERGED"), (3, "nonsense")], log.schema)).count() == 2


def test_words_far_into_a_text_are_found(spark):
    far = "filler " * 30_000
    o = spark.createDataFrame([("d1", far + "kelp harvest"), ("d2", "kelp harvest")] + [(f"f{i}", "other text") for i in range(16)], "object_id string, body string")
    index = search.build_index(o)
    assert rows(index["postings"].filter("term = 'kelp'"), "object_id", "tf") == [("d1", 1), ("d2", 1)]
    assert rows(index["lengths"].filter("object_id = 'd1'"), "len") == [(30_002,)] and rows(index["df"].filter("term = 'kelp'"), "df") == [(2,)]
    assert rows(search.build_index(o, body_cap=200_000)["postings"].filter("term = 'kelp'"), "object_id") == [("d2",)]
    terms = spark.createDataFrame([(1, "kelp")], "query_id int, term string")
    assert {r["object_id"] for r in search.bm25(o, terms).collect()} == {"d1", "d2"}
    # harvest is asked of two short texts; the long one counts in its document frequency
    more = o.union(spark.createDataFrame([("d3", "kelp harvest")], o.schema))
    hits = spark.createDataFrame([(1, "d2", 1), (1, "d3", 2)], "query_id int, object_id string, rank int")
    got = search.expansion_terms(more, hits, terms).first()
    assert got["term"] == "harvest" and abs(got["weight"] - 2 * math.log(19 / 3)) < 1e-5
