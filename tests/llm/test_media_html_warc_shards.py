"""WAV round trips, HTML layout, WARC segments, extendible hashing."""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from html.parser import HTMLParser

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnbook.llm import html_layout, media, sharding, warc


def test_tables_of_very_long_cells_stay_in_proportion():
    page = "<table><tr><td>" + "x" * 1_000_000 + "<td>next" + "<tr><td>a<td>b" * 20_000 + "<tr>" + "<td>c" * 20_000 + "</table>"
    text = html_layout.extract_text(page)
    assert text.count("x") == 1_000_001 and text.count("c") == 20_000 and len(text) < 10 * len(page)


@pytest.mark.parametrize("table", ["docs", "awkward"])
def test_wav_round_trip(request, table):
    rows = request.getfixturevalue(table)
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in rows.collect()}
    got = media.fingerprint(media.store_as_wav(rows)).collect()
    assert len(got) == rows.count()
    prints = {}
    for r in got:
        raw = texts[r["doc_id"]]
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert bytes(r["payload"]) == payload and r["n_bytes"] == len(raw) and bytes(r["media"])[:4] == b"RIFF"
        assert prints.setdefault(payload, r["fingerprint"]) == r["fingerprint"] == sorted(r["fingerprint"])


def test_fingerprint_finds_a_tone_wherever_it_starts():
    t = np.arange(8000)
    tone = (128 + 60 * np.sin(t * 0.3) + 50 * np.sin(t * 1.1)).astype(np.uint8)
    late = np.concatenate([np.full(288 * 10, 128, np.uint8), tone])
    a, b = (media.pair_codes(*media.spectrum_peaks(x)) for x in (tone, late))
    assert len(a) and len(set((a & 0xFFFFFFFF).tolist()) & set((b & 0xFFFFFFFF).tolist())) > 0
    blocks = media.BLOCK
    try:
        media.BLOCK = 3
        assert media.pair_codes(*media.spectrum_peaks(late)).tolist() == b.tolist()
    finally:
        media.BLOCK = blocks


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<table><tr><th>Name<th>Qty<tr><td>apple<td>12</table>", "Name   Qty\napple  12"),
        ("<ol start=3><li>a<li>b<ul><li>x</ul><li>c</ol>", "3. a\n4. b\n   - x\n5. c"),
        ("<p>a<p>b<div>c</div>d", "a\n\nb\n\nc\nd"),
        ("<pre> x\n  y</pre>", " x\n  y"),
        ("<p>x<span style='display: none'>no</span><b hidden>no</b><script>no</script><!-- no -->y&amp;z", "xy&z"),
        ("<head><title>no</title></head><body>yes<br>sir", "yes\nsir"),
        ("<dl><dt>t<dd>d</dl>", "t\n  d"),
        ("<table><tr><td>a<table><tr><td>i<td>j</table><td>b</table>", "a     b\n\ni  j"),
        ("", ""),
        ("a < b & c", "a < b & c"),
    ],
)
def test_layout(html, text):
    assert html_layout.extract_text(html) == text


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<ol start=2001><li>a<li>b<li value=1234567>c<li>d</ol>", "2001. a\n2002. b\n1234567. c\n1234568. d"),
        ("<p>sum <math><mi>x</mi><mo>+</mo><mn>1</mn><annotation>no</annotation></math> is", "sum x+1 is"),
        ("<svg><title>no</title><defs><text>no</text></defs><path d='M0'/><defs/><text>Mon</text><text>Tue</text></svg>end", "Mon Tue end"),
        ("<svg/><p>a<desc>b</desc>", "ab"),
        ("<table><tr><td colspan=5000>a<td>b</table>", "a" + " " * 1999 + "b"),
    ],
)
def test_long_numbers_formulas_and_drawings(html, text):
    assert html_layout.extract_text(html) == text


def test_all_visible_text_is_kept(spark):
    class Plain(HTMLParser):
        def __init__(self):
            super().__init__()
            self.skip, self.out = 0, []

        def handle_starttag(self, tag, attrs):
            self.skip += tag in ("head", "script", "style", "title")

        def handle_endtag(self, tag):
            self.skip -= tag in ("head", "script", "style", "title")

        def handle_data(self, data):
            if not self.skip:
                self.out.append(data)

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    source = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in html_layout.extract_pages(pages).collect():
        p = Plain()
        p.feed(source[r["page_id"]])
        p.close()
        got = re.sub(r"(?m)^\s*(?:- |\d+\. )", "", r["text"])
        assert re.sub(r"\s+", "", got) == re.sub(r"\s+", "", "".join(p.out))


def test_broken_markup_and_depth():
    for html in ("<" * 3000, "<a '" * 500, "</p></td></table>" * 100, "<div><b>" * 20000 + "x", "<table>" * 300 + "x", "<li>" * 2000, "<!--", "<script>", "<p" ):
        html_layout.extract_text(html)


def _pages(spark):
    big = "<p>" + "é" * 30_000 + "</p>"
    rows = [(1, "u", big), (2, "u2", big), (3, None, big), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (7, "v\r\nx", ""), (8, "w", "x" * 1000), (9, "w", "x" * 1000), (None, "n", "y" * 2000)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("record", F.lit("clash")).repartition(3)


def test_warc_round_trip(spark):
    pages = _pages(spark)
    read = warc.read_archives(warc.write_archives(pages, segment=4096)).collect()
    assert len(read) == pages.count()
    html = {r["page_id"]: (r["html"] or "").encode() for r in pages.collect()}
    for r in read:
        raw = html[r["page_id"]]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert r["payload"] is None if r["record_type"] == "revisit" else bytes(r["payload"]) == raw
    assert {r["page_id"]: r["refers_to"] for r in read if r["record_type"] == "revisit"} == {1: 3, 2: 3, 8: 9}
    assert warc.read_archives(warc.write_archives(pages.filter("false"))).count() == 0


def test_chunks_and_missing_segments(spark):
    assert warc.dechunked(b"3;ext=1\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.dechunked(b"5\r\nabc\r\n0\r\n\r\n")
    parts = list(warc.records(1, 0, "u", b"z" * 9000, hashlib.sha1(b"z" * 9000).hexdigest(), None, 4096))
    assert len(parts) == 3 and b"WARC-Segment-Total-Length" in zlib.decompress(parts[-1], 31)


def test_segments_out_of_order_and_missing(spark, tmp_path):
    payload = bytes(range(256)) * 8000
    digest = hashlib.sha1(payload).hexdigest()
    parts = list(warc.records(7, 0, "u", payload, digest, None, 16384))
    assert len(parts) > 100

    def manifest(*files):
        paths = []
        for k, own in enumerate(files):
            paths.append((f"{tmp_path}/{uuid.uuid4().hex}-{k}.warc.gz", len(own)))
            open(paths[-1][0], "wb").write(b"".join(own))
        return spark.createDataFrame(paths, "path string, n_records long")

    got = warc.read_archives(manifest(parts[:0:-1], parts[:1])).collect()
    assert [(r["page_id"], bytes(r["payload"]), r["payload_digest"]) for r in got] == [(7, payload, digest)]
    for bad in (parts[:50] + parts[51:], parts[:-1], parts + parts[9:10]):
        with pytest.raises(Exception, match="segments"):
            warc.read_archives(manifest(bad)).collect()


def test_warc_equals_its_sql(spark):
    c = duckdb.connect()
    c.execute("CREATE VIEW pages AS SELECT * FROM '/root/testdata/sf0.001/pages.parquet'")
    want = sorted(c.execute(warc.OP9_SQL).fetchall(), key=str)
    got = warc.op9_warc_segments(spark, "/root/testdata/sf0.001").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=str) == want


@pytest.mark.parametrize("table", ["docs", "awkward"])
def test_shards_are_the_shortest_prefixes_that_fit(request, table):
    rows = request.getfixturevalue(table)
    limit = 60_000
    got = sharding.extendible_shards(rows, byte_limit=limit).collect()
    assert len(got) == rows.count()
    total: dict = {}
    for r in got:
        assert len(r["shard"]) == r["depth"]
        total.setdefault(r["shard"], []).append(r["bytes"])
    for shard, sizes in total.items():
        assert sum(sizes) <= limit or len(sizes) == 1
        if shard:  # the bucket it was split from was too large
            assert sum(sum(v) for k, v in total.items() if k.startswith(shard[:-1])) > limit
        assert not any(k != shard and k.startswith(shard) for k in total)
    assert all((r["shard_bytes"], r["shard_docs"]) == (sum(total[r["shard"]]), len(total[r["shard"]])) for r in got)


def test_equal_keys_split_too(spark):
    rows = spark.range(400).select(F.lit(7).alias("doc_id"), F.repeat(F.lit("a"), 100).alias("text"))
    got = sharding.extendible_shards(rows, byte_limit=1000).collect()
    assert len(got) == 400 and max(r["shard_bytes"] for r in got) <= 1000


def test_shard_files(docs):
    at = sharding.write_shards(docs, byte_limit=200_000)
    back = docs.sparkSession.read.parquet(at)
    assert back.count() == docs.count() and back.select("shard").distinct().count() > 1


def test_empty(empty, spark):
    assert sharding.extendible_shards(empty).count() == 0
    assert media.fingerprint(media.store_as_wav(empty)).count() == 0
    assert html_layout.extract_pages(_pages(spark).filter("false")).count() == 0
