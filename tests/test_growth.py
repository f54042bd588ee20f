"""Steps whose cost must not grow faster than their input, held against plain loops and by their plans."""

from __future__ import annotations

import numpy as np

from cairnbook.operators import bundles, graph, ingest, search, semantic
from cairnbook.sources import markup


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_a_word_brings_no_more_entities_than_a_query_keeps(spark):
    titles = [(f"e{i:03d}", "Ring" if i in (150, 190) else f"{'large' if i % 2 else 'small'} ring {i % 7}") for i in range(200)]
    queries = [("a", "large ring"), ("b", "ring"), ("c", "SMALL thing"), ("d", "the at")]
    met = search.match_entities(spark.createDataFrame(queries, "query_id string, query string"), spark.createDataFrame(titles + titles[:5], "object_id string, title string"))
    want = set()
    for q, text in queries:
        terms = {t for t in text.lower().split() if len(t) >= 4}
        hits = sorted((t.lower() not in terms, o, t) for o, t in titles if terms & set(t.lower().split()))
        want |= {(q, o, t, not no) for no, o, t in hits[:8]}
    assert {tuple(r) for r in met.select("query_id", "object_id", "title", "exact").collect()} == want
    assert "WindowGroupLimit [term" in plan(met)


def test_messages_of_one_file_are_parsed_by_many_tasks_and_once(spark):
    raw = [("box", f"From: a@x.example\nTo: b@x.example\nSubject: s{i}\nMessage-ID: <{i}@x>\nIn-Reply-To: <{i - 1}@x>\n\nhello {i}\n") for i in range(40)]
    parsed = markup.parse_messages(spark.createDataFrame(raw, "mailbox string, raw string").coalesce(1))
    assert parsed.rdd.getNumPartitions() >= 4
    items, edges, files = markup.scan_mail(parsed, spark.createDataFrame([("box", "a@x.example")], "mailbox string, identity string"))
    assert items.count() == 40 and edges.count() == 40 and files.count() == 0
    assert not any("InPandas" in plan(df) for df in (items, edges, files))


def test_vectors_meet_in_blocks_and_no_pair_is_lost(spark, monkeypatch):
    monkeypatch.setattr(semantic, "ROWS", 70)
    monkeypatch.setattr(semantic, "ASKED", 30)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 16))
    every = np.concatenate([x, x + 0.47 * rng.normal(size=x.shape)])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(every)], "vec_id long, embedding array<double>")
    met = semantic.similar_vectors(rows, rows.filter("vec_id % 4 = 0"))
    unit = every / np.linalg.norm(every, axis=1)[:, None]
    c = np.round(unit[::4] @ unit.T, 6)
    assert {(r["query_id"], r["object_id"]) for r in met.collect()} == {(4 * i, j) for i, j in zip(*np.nonzero(c >= 0.9), strict=True) if 4 * i != j}
    assert "bucket" not in plan(met)


def test_search_reads_texts_once_per_set_of_terms(spark):
    docs = spark.createDataFrame([("d1", "apple pear apple"), ("d2", "pear fig"), ("d3", None)], "object_id string, body string").coalesce(1)
    terms = spark.createDataFrame([("q", "apple"), ("q", "pear")], "query_id string, term string")
    met = search.bm25(docs, terms)
    assert [(r["object_id"], r["matched"]) for r in met.orderBy("rank").collect()] == [("d1", 2), ("d2", 1)]
    assert search.totals_of(search.counted(docs, terms)).collect() == [(3, 5 / 3)]
    assert "split(" not in plan(met)


def test_mentions_read_texts_once(spark):
    objects = spark.createDataFrame([(f"d{i}", "see Example com and more" if i < 2 else "none") for i in range(50)], "object_id string, body string").coalesce(1)
    met = graph.mentions(objects, spark.createDataFrame([("example.com",), ("more",)], "title string"))
    assert sorted((r["title"], r["object_id"]) for r in met.collect()) == [("example.com", "d0"), ("example.com", "d1"), ("more", "d0"), ("more", "d1")]
    assert "regexp_count" not in plan(met) and "body" not in plan(met)
    assert graph.mentions(objects.limit(0), spark.createDataFrame([("example.com",)], "title string")).count() == 0


def test_files_are_read_once(spark):
    whole = "a" * 64
    files = spark.createDataFrame([(whole, 1, b"x")], "name string, length long, content binary")
    met = bundles.account_for_files(files, spark.createDataFrame([(whole,)], "content_hash string"))
    assert [tuple(r) for r in met.collect()] == [(whole, "corrupt", False)] and "content#" not in plan(met)


def test_bodies_stay_out_of_the_steps_of_a_batch(spark, tmp_path, monkeypatch):
    seen = []
    whole = ingest.ingest_outcomes
    monkeypatch.setattr(ingest, "ingest_outcomes", lambda items, heads: seen.append(items.columns) or whole(items, heads))
    rows = spark.createDataFrame([("s", "a", "n1", "h1", "one", 0), ("s", "a", "n1", "h2", "two", 1), ("s", "a", "n1", "h2", "two", 1), ("s", None, "n2", "h3", None, 0)], "source_id string, account_id string, native_id string, content_hash string, body string, seq int")
    ingest.ingest_batch(spark, str(tmp_path), rows, 1, "2026-01-01")
    got = ingest.read_table(spark, str(tmp_path), "object_version").select("content_hash", "body", "version_num")
    assert sorted(map(tuple, got.collect())) == [("h1", "one", 1), ("h2", "two", 2), ("h3", None, 1)]
    assert "body" not in seen[0]
