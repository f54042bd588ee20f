"""Column functions, each on values whose results are known."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from cairnbook.functions import text as tx
from cairnbook.functions import times
from cairnbook.functions.urls import canonicalize_url, registrable_domain


def values(spark, items, column, kind="string"):
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(items)], f"k int, x {kind}")
    return [r["y"] for r in rows.select("k", column(F.col("x")).alias("y")).orderBy("k").collect()]


@pytest.mark.parametrize(
    ("url", "normal", "rule"),
    [
        ("HTTP://www.Example.com:80/a/index.html?utm_source=x&b=2&a=1#top", "http://example.com/a?a=1&b=2", "stripped_www"),
        ("example.com", "http://example.com/", "added_missing_scheme:http"),
        ("//example.com/A/", "https://example.com/A", "protocol_relative->https"),
        ("https://user:pw@example.com/p", "https://example.com/p", "stripped_userinfo"),
        ("https://example.com/p#!route", "https://example.com/p#!route", None),
        ("https://www.com/", "https://www.com/", None),
        ("http://localhost:8080/x", "http://localhost:8080/x", None),
        ("", None, "EMPTY"),
        (None, None, "EMPTY"),
        ("http://nodots/", None, "INVALID_HOST"),
        ("http://a..b/", None, "INVALID_HOST"),
        ("http://example.com:99999/", None, "INVALID_PORT"),
        ("mailto:joe@example.com", None, "INVALID_HOST"),
        ("javascript:location.href='http://x.y'", None, "INVALID_HOST"),
        ("localhost:8080/x", None, "INVALID_HOST"),
        ("http://a.example/?q=&b", "http://a.example/?b=&q=", "sorted_query_params"),
        ("http://bücher.example/", "http://xn--bcher-kva.example/", "idna_encoded_host"),
        ("http://a.example/?x=%7e*%20%zz", "http://a.example/?x=~%2A+%25zz", None),
        ("http://a.example:080/?gclid=1&UTM_ID=2", "http://a.example/", "dropped_tracking_params:UTM_ID,gclid"),
    ],
)
def test_canonical_url(spark, url, normal, rule):
    (got,) = values(spark, [url], canonicalize_url)
    assert got["normalized_url"] == normal
    assert rule is None or rule in got["rules"]


def test_canonical_url_is_idempotent(spark, small):
    p = spark.read.parquet(f"{small}/pages.parquet").select(canonicalize_url(F.col("url"))["normalized_url"].alias("a"))
    assert p.filter(F.col("a") != canonicalize_url(F.col("a"))["normalized_url"]).count() == 0


def test_registrable_domain(spark):
    assert values(spark, ["a.b.example.com", "x.co.uk", "y.x.co.uk", "com", None, ""], registrable_domain) == ["example.com", "x.co.uk", "x.co.uk", "com", None, None]


def test_timestamps(spark):
    at = datetime(2024, 3, 15, 10, 0, 0)
    texts = ["1710496800", "1710496800000", "1710496800000000", "2024-03-15T10:00:00Z", "2024-03-15T11:00:00.123+01:00", "2024-03-15 10:00:00", "Fri, 15 Mar 2024 10:00:00 +0000"]
    assert values(spark, texts, times.ts_iso) == [at] * len(texts)
    assert values(spark, ["2024-03-15", "15 Mar 2024"], times.ts_iso) == [datetime(2024, 3, 15)] * 2
    assert values(spark, ["true", "", None, "999999999999999999999"], times.ts_iso) == [None] * 4
    assert values(spark, [11644473600000000 + 1710496800000000, 0, -5, None], times.chrome_ts, "long") == [at, None, None, None]


def test_identifiers(spark):
    assert values(spark, ["12345", "deadbeef12", "word", "a1b2c3d4e5f6g7", "x" * 21, "ab1"], tx.is_identifier) == [True, True, False, True, True, True]


def test_links_and_tags(spark):
    note = "# T\n[[a/b#h|Alias]] ![[pic.png]] `[[no]]` #tag/x #fff [m](other%20note.md#s) [e](https://x.y)\n```\n[[nor]]\n```"
    (wiki,) = values(spark, [note], tx.wikilinks)
    assert [(w["bang"], w["target"], w["alias"]) for w in wiki] == [(False, "a/b", "Alias"), (True, "pic.png", None)]
    assert values(spark, [note], tx.markdown_links) == [["other note.md"]]
    assert values(spark, [note], tx.hash_tags) == [["tag/x"]]


def test_small_text_functions(spark):
    assert values(spark, [None, "", " a  b "], tx.word_count) == [0, 0, 2]
    assert values(spark, ["<p>a &amp; b</p><script>x</script>"], tx.detag) == ["a & b"]
    assert values(spark, ["Ã©tÃ©", "plain", None], tx.fix_mojibake) == ["été", "plain", None]
    assert values(spark, ["---\ntitle: 'T'\ntags: [a, b]\nlist:\n- x\n- y\n---\nbody", "none", "---\nopen"], tx.frontmatter) == [{"title": "T", "tags": "a,b", "list": "x,y"}, {}, {"_unparsed": "true"}]
    assert values(spark, ["2024-03-15 note", "20240315", "none"], lambda c: tx.note_date(c).cast("string")) == ["2024-03-15", "2024-03-15", None]
    assert values(spark, [10, 1280, 5 << 20], tx.human_size, "long") == ["10 B", "1.2 KB", "5.0 MB"]
    assert values(spark, ["a b c d target e f"], lambda c: tx.snippet(c, F.lit("target"), 4)) == ["c d [target] e"]
