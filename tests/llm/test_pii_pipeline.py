"""PII base spans against Python's re, added spans, redaction; the pipeline stage by stage."""

from __future__ import annotations

import hashlib
import math
import os
import re

import pytest
from pyspark.sql import functions as F

from cairnbook.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
ODD = [
    "a@b.c_x@y.zz %@x.y a@b a.b@c-d.e.f. @x.y a@b.c.%q@w.e", "1.2.3.4.5.6.7.8 1.2.3 256.1.1.1 0001.2.3.0255 12.34.56.78.90", "4111 1111 1111 1111 4111-1111-1111-1111 4111111111111112 4111  1111",
    "+1 (555) 010-9999 + 1 555 +1-2 +12345678901234567890 +49.30.1234567(", "🙂 é jo@example.org 🙂 +44 20 7946 0958", "4111111111111111 5500005555555559", "", "token = \"" + "ab12" * 10 + "\"",
]


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        s = sum((int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) if i % 2 else int(c) for i, c in enumerate(reversed(d)))
        return 13 <= len(d) <= 19 and s % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def spans(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if valid(k, m[0])]


@pytest.fixture(scope="module")
def model(spark):
    return pii.fit(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))


@pytest.mark.parametrize("table", ["docs", "awkward", "odd"])
def test_base_spans(request, spark, model, table):
    rows = spark.createDataFrame(list(enumerate([*ODD, None])), "doc_id long, text string") if table == "odd" else request.getfixturevalue(table)
    texts = {r["doc_id"]: r["text"] for r in rows.collect()}
    got = pii.find(rows, model).collect()
    assert len(got) == rows.count()
    for r in got:
        want = spans(texts[r["doc_id"]])
        assert [(k, s["start"], s["end"]) for k in pii.BASE_KINDS for s in r["base"][k]] == want
        every = [(s["kind"], s["start"], s["end"]) for s in r["spans"]]
        assert set(want) <= set(every) and every == sorted(every, key=lambda x: (pii.KINDS.index(x[0]), x[1]))
        added = [x for x in every if x not in want]
        assert all(a[2] <= b[1] or b[2] <= a[1] for a in added for b in every if a != b)


def test_added_spans_find_what_base_patterns_run_together(spark, model):
    rows = spark.createDataFrame([(0, "pay 4111111111111111 5500005555555559 now"), (1, "nothing here but words 12 and 2024-01-01")], "doc_id long, text string")
    got = {r["doc_id"]: [(s["kind"], s["start"]) for s in r["spans"]] for r in pii.find(rows, model).collect()}
    assert got == {0: [("card", 4), ("card", 21)], 1: []}


def test_redaction(spark, model):
    rows = spark.createDataFrame([(0, "é jo@example.org, 10.0.0.1!"), (1, None), (2, "clean")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in pii.redact(pii.find(rows, model)).collect()}
    assert got == {0: "é [EMAIL], [IP]!", 1: None, 2: "clean"}


def test_long_runs_do_not_break_the_patterns(spark, model):
    texts = ["1 " * 60_000, "a." * 60_000, "+1" + "(" * 60_000, "1." * 1_500, "a@b" + ".c" * 60_000, "x" * 200_000]
    assert pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).select(F.size("spans")).count() == len(texts)


def test_no_model_without_candidates(empty, spark):
    m = pii.fit(empty)
    assert pii.find(empty, m).count() == 0
    rows = spark.createDataFrame([(1, "jo@example.org")], "doc_id long, text string")
    assert pii.find(rows, m).first()["spans"][0]["kind"] == "email"


def test_boosting_learns_a_rule():
    cells = [((g, d, 0, c, 0, 0, 0), 10.0 if c == 1 else 0.0, 0.0 if c == 1 else 10.0) for g in range(3) for d in range(4) for c in range(3)]
    trees = pii._boost(cells)
    assert all((pii._score(trees, x) > 1) == (pos > neg) for x, pos, neg in cells)


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    kept = {r["doc_id"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == names
        rows = out.collect()
        docs = spark.createDataFrame(rows, out.schema)
        ids = [r["doc_id"] for r in rows]
        assert set(ids) <= kept and (len(ids) == len(set(ids)) or name == "mixing")
        if name == "pii":
            assert not any(spans(r["text"]) for r in rows) and all(r["n_chars"] == len(r["text"]) for r in rows)
        kept = set(ids)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    got = corpus_pipeline.run(spark, sf)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, last.collect())) and got.count() == docs.count()


def test_only_the_last_table_of_the_pipeline_stays(spark):
    import corpus_pipeline
    from cairnbook.llm.shared import shared_dir

    at = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(at))
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0
    assert [x.rsplit("-", 1)[0] for x in set(os.listdir(at)) - before] == ["pipeline-mixing"]


def test_clean_text_with_wide_matches_stays(spark, model):
    texts = ["we sold apples @ 2.50 today", "see you @ home.Then we go", "your invoice 100-200-3000 is due", "order no. 100-200-3000"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in pii.redact(pii.find(rows, model)).collect()} == dict(enumerate(texts))


def test_thresholds_calibrate_on_both_labels(spark):
    texts = [f"a{i} call 555-010-{1000 + i} now" for i in range(200)] + [f"a{i} invoice 555-010-{1000 + i} now" for i in range(200)]
    every = pii._proposed(spark.createDataFrame([(t,) for t in texts], "text string")).select(F.explode(F.transform("_all", lambda x: pii._featured(x))).alias("p")).select("p.*")
    labels = {(r["ok"], r["y"]): r["n"] for r in every.filter("kind = 'phone'").groupBy("ok", "y").agg(F.count("*").alias("n")).collect()}
    assert labels == {(True, True): 200, (True, False): 200}
    both = [(2.0, 50.0, 1.0), (0.5, 50.0, 40.0)]
    assert pii._threshold(both, both) == 2.0


def test_thresholds_of_kinds_with_few_labels_lean_on_the_others():
    pooled = [(2.0, 90.0, 1.0), (0.5, 50.0, 40.0)]
    assert [pii._threshold(own, pooled) for own in ([], [(2.0, 1.0, 0.0)], [(2.0, 4.0, 0.0)], [(2.0, 5.0, 0.0)])] == [2.0] * 4
    assert pii._threshold([(2.0, 0.0, 3.0)], pooled) == math.inf and pii._threshold([], []) == math.inf


def test_added_spans_equal_a_plain_run_of_the_model(spark, model):
    """Proposals and their features come from the table; scores, thresholds, overlaps and base spans are done again in
    plain Python."""
    texts = ["call 555-010-7777 or (555) 010-8888", "contact jo (at) mail (dot) example (dot) com", "card 4111.1111.1111.1111 10.0.0.7", 'token = "' + "a1" * 20 + '" invoice 555-010-7777', "no. 4111111111111111 x", "+1 555 010 99991111 4111111111111111"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").unionByName(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text"))
    found = {(r["doc_id"], r["text"]): r for r in pii.find(docs, model).collect()}
    props = pii._proposed(docs).select("doc_id", "text", F.transform("_all", lambda x: pii._featured(x)).alias("p")).collect()
    for row in props:
        got = found[(row["doc_id"], row["text"])]
        base = [(s["start"], s["end"]) for k in pii.BASE_KINDS for s in got["base"][k]]
        good = []
        for x in row["p"]:
            score = pii._score(model["trees"], tuple(x[f] for f in pii.FEATURES))
            if x["ok"] and score >= model["thresholds"][x["kind"]] - 1e-9 and all(b <= x["s"] or x["e"] <= a for a, b in base):
                good.append((x["s"], -x["e"], x["kind"], score))
        kept, last = [], None
        for s, e, kind, score in sorted(good):
            if last is None or s >= last[1]:
                kept.append(last)
                last = (s, -e, kind, score)
            elif score > last[3] + 1e-9 or (abs(score - last[3]) <= 1e-9 and -e - s > last[1] - last[0]):
                last = (s, -e, kind, score)
        want = sorted((k[2], k[0], k[1]) for k in [*kept, last] if k)
        added = sorted((s["kind"], s["start"], s["end"]) for s in got["spans"] if (s["start"], s["end"]) not in base)
        assert added == want, row["text"]


def test_columns_of_any_name_pass(spark, model):
    docs = spark.createDataFrame([(1, "write to a@b.example.com", "t", 5, "e", "r", "a")], "doc_id long, text string, _text string, _all int, _email string, _raw_email string, _added string")
    row = pii.find(docs, model).first()
    assert (row["_text"], row["_all"], row["_email"], row["_raw_email"], row["_added"], len(row["spans"])) == ("t", 5, "e", "r", "a", 1)


def test_many_matches_take_time_in_proportion(spark, model):
    import time

    took = []
    for n in (1000, 4000, 8000):
        docs = spark.createDataFrame([(" ".join(f"call +1 (555) 010-{k:04d}" for k in range(n)),)], "text string")
        began = time.time()
        assert pii.find(docs, model).select(F.size("spans")).first()[0] == n
        took.append(time.time() - began)
    assert took[2] < 2 * took[1] + 1


def test_scores_accept_and_reject_valid_candidates_without_cues(spark):
    """Dotted telephone numbers stand for invoices only, dashed ones for calls; hex in quotes for secrets, dashed words
    with digits for none. Without any cue nearby the forms decide."""
    hexes = lambda i: hashlib.sha256(str(i).encode()).hexdigest()[:40]
    rows = []
    for i in range(400):
        rows += [f"a{i} call 555-010-{1000 + i} now", f"b{i} invoice no. 555.010.{1000 + i} now", f'c{i} token = "{hexes(i)}" now', f"d{i} some-long-name-of-{i}-many-words here"]
    model = pii.fit(spark.createDataFrame([(r,) for r in rows], "text string"))
    assert all(model["thresholds"][k] < math.inf for k in ("phone", "secret"))
    asked = ["z 555-010-7777 y", "z 555.010.7777 y", f'z "{hexes(9999)}" y', "z another-long-name-of-77-many-words y"]
    table = pii._proposed(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"))
    # all four pass their validators, and none has a cue
    cands = table.select("doc_id", F.explode(F.transform("_all", lambda x: pii._featured(x))).alias("p")).filter("p.kind in ('phone', 'secret') and p.ok and p.ctx = 0")
    assert {r["doc_id"] for r in cands.collect()} == {0, 1, 2, 3}
    got = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in pii.find(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), model).collect()}
    assert got == {0: ["phone"], 1: [], 2: ["secret"], 3: []}


def test_given_tables_have_secrets_and_their_share_is_found(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    assert model["thresholds"]["secret"] < math.inf
    with_secret = docs.filter(F.col("text").rlike(r'token = "[0-9a-f]{40}"'))
    met = pii.find(with_secret, model).select(F.exists("spans", lambda x: x["kind"] == "secret").alias("met")).agg(F.avg(F.col("met").cast("double")).alias("share"), F.count("*").alias("n")).first()
    assert met["n"] > 100 and met["share"] == 1.0


def test_pipeline_keeps_rows_of_null_and_shared_ids(spark):
    import corpus_pipeline

    text = lambda k: " ".join(f"word{k}x{i}" for i in range(40))
    clean = [(1, text(0)), (1, text(1)), (None, text(2)), (None, text(3)), (2, text(4))]
    rows = [(i, t, "en", "a", len(t)) for i, t in [*clean, (1, "junk"), (None, "junk"), (3, text(0)), (None, text(3))]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    judged = corpus_pipeline.quality_stage(spark, docs, "")
    assert sorted(r["text"] for r in judged.collect()) == sorted([t for _, t in clean] + [text(0), text(3)])
    single = corpus_pipeline.near_dedup_stage(spark, judged, "")
    got = {(r["doc_id"], r["text"]) for r in single.collect()}
    assert got == {(3, text(0)), *clean[1:]} and single.count() == 5
    # 300 words may be taken of 200: every row once at least
    mixed = [(r["doc_id"], r["text"]) for r in corpus_pipeline.mixing_stage(spark, single, "").collect()]
    assert set(mixed) == got and len(mixed) in (7, 8)
    assert corpus_pipeline.byte_bpe_stage(spark, single, "").count() == 5


def test_every_stage_takes_empty_tables_nulls_and_extra_columns(spark, tmp_path):
    import corpus_pipeline

    rows = [(1, None, None, None, None, "x"), (None, "a b " * 30, "en", "s", 5, "y"), (None, "a b " * 30, "en", "s", 5, "y"), (3, "", "de", None, 0, "z"), (4, " ".join(f"w{k}" for k in range(60)), "en", "s", 300, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _row string")
    for name, stage in corpus_pipeline.STAGES:
        for table in (docs, docs.filter("false")):
            out = stage(spark, table, "/root/testdata/sf0.001")
            count = out.count()
            assert count == 0 if table is not docs else count <= 2 * len(rows)
            assert out.columns == (corpus_pipeline.COLUMNS if name != "byte_bpe" else ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
