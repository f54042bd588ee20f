"""Scans over small invented exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnbook.sources import files, items, markup, records


def write(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data if isinstance(data, bytes) else data.encode())


def test_files_are_excluded_counted_and_hashed(spark, tmp_path):
    for name in ("a/one.txt", "a/two.md", "b/three.csv", "b/copy.txt", "b/code.py", "node_modules/x.txt", ".hidden/y.txt", "b/odd.zzz"):
        write(tmp_path / "tree" / name, "same" if name in ("a/one.txt", "b/copy.txt") else name)
    for name in ("HEAD", "objects/aa/x.txt", "refs/y.txt"):
        write(tmp_path / "tree/repo" / name, "z")
    f = files.list_files(spark, str(tmp_path / "tree"))
    root = f"file:{tmp_path}/tree/"
    got = files.scan_files(f, root).collect()
    assert sorted(r["native_id"] for r in got) == ["a/one.txt", "a/two.md", "b/copy.txt", "b/three.csv"]
    assert len({r["content_hash"] for r in got}) == 3
    report = {r["reason"]: r["n"] for r in files.excluded_file_report(f, root).collect()}
    assert report["extension"] == 1 and report["folder"] == 1
    assert files.changed_files(f, f).count() == 0


def test_bookmarks(spark):
    text = '<DL><p><DT><H3>Work</H3><DL><p><DT><A HREF="http://a.example/" ADD_DATE="1700000000">A &amp; B</A><DT><H3>Deep</H3><DL><p><DT><A HREF="b">B</A></DL></DL><DT><A HREF="c">C</A></DL>'
    got = markup.scan_bookmarks(spark.createDataFrame([("f", text), ("g", None)], "path string, text string")).collect()
    assert [(r["href"], r["title"], r["folder"]) for r in got] == [("http://a.example/", "A & B", "Work"), ("b", "B", "Work/Deep"), ("c", "C", "")]


def test_mailbox(spark, tmp_path):
    one = "From x\nFrom: me@home.example\nTo: you@there.example\nSubject: =?utf-8?q?caf=C3=A9?=\nMessage-ID: <1>\nDate: Fri, 15 Mar 2024 10:00:00 +0000\n\nhello there\n"
    two = "From y\nFrom: you@there.example\nTo: me@home.example\nSubject: no id\nIn-Reply-To: <1>\nContent-Type: text/html\n\n<p>rich <b>text</b></p>\n"
    write(tmp_path / "box.mbox", one + "\n" + two)
    m = markup.parse_messages(markup.read_mailboxes(spark, str(tmp_path / "box.mbox"))).collect()
    assert {r["subject"] for r in m} == {"café", "no id"} and sum(r["message_id"].startswith("sha256:") for r in m) == 1
    assert {r["body_part"] for r in m} == {"plain", "html"} and all(r["error"] is None for r in m)
    guard = items.identity_guard(spark.createDataFrame([("b", "me@home.example", "me@home.example"), ("b", "z", "me@home.example"), ("c", "z", "me@home.example")], "mailbox string, addresses string, identity string"))
    assert {r["mailbox"]: r["ok"] for r in guard.collect()} == {"b": True, "c": False}


def test_csv_header_below_a_preamble(spark):
    text = "Notes:\nsome words\n\nName,City,Note\nAnn,Rome,x\nBob,Oslo,\n"
    got = markup.read_csv_rows(spark.createDataFrame([("f", bytearray(text.encode()))], "path string, content binary")).collect()
    assert [r["row"]["Name"] for r in got] == ["Ann", "Bob"]


def test_vault(spark, tmp_path):
    write(tmp_path / "v/a.md", "---\ntitle: Alpha\ntags: [x]\n---\n[[b]] ![[pic.png]] #y/z [m](b.md)")
    write(tmp_path / "v/b.md", "plain")
    notes, links = files.scan_vault(files.list_files(spark, str(tmp_path / "v")), f"file:{tmp_path}/v/")
    assert {r["title"] for r in notes.collect()} == {"Alpha", "b"}
    assert {(r["target"], r["type"]) for r in links.collect()} == {("b", "LINKS_TO"), ("pic.png", "EMBEDS"), ("b.md", "LINKS_TO")}


def test_chat_tree_branch(spark):
    nodes = spark.createDataFrame([("c", "r", None), ("c", "a", "r"), ("c", "b", "a"), ("c", "old", "a"), ("c", "d", "b")], "conversation_id string, node string, parent string")
    conversations = spark.createDataFrame([("c", "d")], "conversation_id string, current_node string")
    got = {r["node"]: r["on_current_branch"] for r in records.current_branch(conversations, nodes).collect()}
    assert got == {"r": True, "a": True, "b": True, "old": False, "d": True}


def test_history_and_activity(spark):
    h = spark.createDataFrame([([("T", "http://x.example", 13355000000000000)],)], "`Browser History` array<struct<title:string,url:string,time_usec:bigint>>")
    (v,) = records.scan_browser_history(h).collect()
    assert v["ts"].year == 2024
    a = spark.createDataFrame([("t", "http://y.example", "2024-01-01T00:00:00Z", "My Activity/Search/a.json"), ("t", None, None, "p/q")], "title string, titleUrl string, time string, path string")
    assert [(r["product"], r["url"]) for r in records.scan_activity(a).collect()] == [("Search", "http://y.example")]


def test_checks_on_exports(spark):
    listing = spark.createDataFrame([("x/part-1.json", "part-1.json")], "path string, name string")
    manifest = spark.createDataFrame([("part-1.json",), ("part-2.json",)], "name string")
    assert [r["name"] for r in items.export_completeness(manifest, listing).collect()] == ["part-2.json"]
    found = items.loud_scan(listing, spark.createDataFrame([("part-",), ("none",)], "pattern string"))
    assert {r["pattern"]: r["n"] for r in found.collect()} == {"part-": 1, "none": 0}
    two = spark.createDataFrame([("d", "a", "1"), ("d", "b", "2")], "dataset string, name string, content_hash string")
    assert items.dataset_tag(two).first()["tag"] == items.dataset_tag(two.orderBy(F.desc("name"))).first()["tag"]


def test_current_branch_ends_on_cycles_and_without_a_current_node(spark):
    nodes = spark.createDataFrame(
        [("c", "a", "b"), ("c", "b", "a"), ("c", "x", None), ("d", "r", None), ("d", "k1", "r"), ("d", "k2", "r"), ("d", "l", "k2"), ("e", "r", "gone"), ("e", "s", "r")], "conversation_id string, node string, parent string"
    )
    chats = spark.createDataFrame([("c", "a"), ("d", None), ("e", "s")], "conversation_id string, current_node string")
    got = {(r["conversation_id"], r["node"]) for r in records.current_branch(chats, nodes).filter("on_current_branch").collect()}
    assert got == {("c", "a"), ("c", "b"), ("d", "r"), ("d", "k2"), ("d", "l"), ("e", "r"), ("e", "s")}


def test_declared_exports_need_their_account_and_ignore_order(spark):
    import pytest

    from cairnbook.sources import declared

    rows = spark.createDataFrame([("a/skills.csv", {"Name": "x", "More": "1"}), ("b/skills.csv", {"More": "2", "Name": "x"}), ("c/skills.csv", {"Other": "y"}), ("d/new.csv", {"b": "2", "a": None}), ("e/new.csv", {"a": " "}), ("f/shares.csv", {"Date": "2024-05-01", "ShareLink": "https://x.example/1"})], "path string, row map<string,string>")
    with pytest.raises(ValueError, match="linkedin"):
        declared.scan_declared(rows, "linkedin", " ")
    items, urls, files = declared.scan_declared(rows, "linkedin", "me")
    got = {r["native_path"]: r for r in items.collect()}
    assert got["a/skills.csv"]["native_id"] == got["b/skills.csv"]["native_id"] != got["c/skills.csv"]["native_id"]
    assert got["d/new.csv"]["object_class"] == "TabularRecord" and got["d/new.csv"]["title"] == "2" and "e/new.csv" not in got
    assert [(r["url"], str(r["ts"])[:10]) for r in urls.collect()] == [("https://x.example/1", "2024-05-01")]
    assert {r["path"] for r in files.collect() if not r["recognised"]} == {"d/new.csv", "e/new.csv"}
