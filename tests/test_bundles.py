"""Bundles, digest trees and the account of stored files."""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import functions as F

from cairnbook.operators import bundles
from cairnbook.plans import registry, store


def blobs_of(spark, texts):
    return spark.createDataFrame([(sha256(t.encode()).hexdigest(), t.encode(), len(t)) for t in texts], "content_hash string, content binary, bytes int")


def test_files_on_disk(spark, tmp_path):
    h = [sha256(bytes([k])).hexdigest() for k in range(6)]
    for name, data in ((h[0], b"\x00"), (h[1], b"changed"), (f"{h[0]}.tmp-7", b""), (f"{h[2]}.tmp-8", b"\x02"), (f"{h[1]}.tmp-9", b"x"), (f"{h[5]}.tmp-1", b"y"), ("notes", b"z"), (h[4], b"\x04")):
        at = tmp_path / "blobs" / name[:2]
        at.mkdir(parents=True, exist_ok=True)
        (at / name).write_bytes(data)
    known = spark.createDataFrame([(x,) for x in (h[0], h[1], h[2], h[3], h[0])], "content_hash string")
    got = sorted((r["name"], r["state"], r["prunable"]) for r in bundles.account_for_files(bundles.list_files(spark, str(tmp_path / "blobs")), known).collect())
    assert got == sorted([
        (h[0], "ok", False), (h[1], "corrupt", False), (h[2], "missing", False), (h[3], "missing", False), (h[4], "foreign", False), ("notes", "foreign", False),
        (f"{h[0]}.tmp-7", "partial", True), (f"{h[2]}.tmp-8", "partial", False), (f"{h[1]}.tmp-9", "partial", False), (f"{h[5]}.tmp-1", "partial", False),
    ])


def test_files_are_written_and_listed_by_tasks(spark, tmp_path):
    rows = [("abcd1", b"one\n"), ("abcd1.tmp-2", b""), ("ab_c d%20", "\u00e9".encode()), ("ab", b"\xff\x00"), ("abab", b"x"), ("t.gz", b"plain")]
    at = tmp_path / "files"
    for _ in range(2):  # as by an attempt that is made again
        bundles.write_files(spark.createDataFrame(rows, "name string, content binary").repartition(3), str(at))
    assert {str(p.relative_to(at)) for p in at.rglob("*") if p.is_file()} == {"abc/abcd1", "abc/abcd1.tmp-2", "ab-/ab_c d%20", "ab/ab", "aba/abab", "t-g/t.gz"}
    (tmp_path / "files-begun" / "left").write_bytes(b"half")
    (at / "name=one").mkdir()
    (at / "name=one" / "part-0.txt").write_bytes(b"1")
    (at / "name=one" / ".part-0.txt.crc").write_bytes(b"2")
    (at / "_SUCCESS").write_bytes(b"")
    listing = bundles.list_files(spark, f"file://{at}")
    assert sorted((r["name"], bytes(r["content"]), r["length"]) for r in listing.collect()) == sorted((n, c, len(c)) for n, c in [*rows, ("one", b"1")])
    assert {r["path"] for r in listing.select("path").collect()} == {str(p) for p in at.rglob("*") if p.is_file() and p.name[0] not in "._"}
    # the reader's list on the driver would name each file
    assert not any("abcd1" in p or "name=one" in p for p in listing.inputFiles())


def test_an_empty_folder_has_no_files(spark, tmp_path):
    bundles.write_files(spark.createDataFrame([], "name string, content binary"), str(tmp_path / "none"))
    assert bundles.list_files(spark, str(tmp_path / "none")).count() == 0


def test_stored_files_lie_by_their_digits(spark, small, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "new_folder", lambda s, name: str(tmp_path / name))
    states = {r["name"]: r["state"] for r in registry.QUERIES["V07_stored_files"](spark, small).collect()}
    found = {p.name: p for p in (tmp_path / "files").rglob("*") if p.is_file()}
    assert set(found) == {name for name, state in states.items() if state != "missing"}
    for name, p in found.items():
        assert p.relative_to(tmp_path / "files").parts == (name[:3], name)
        assert (sha256(p.read_bytes()).hexdigest() == name) == (states[name] == "ok")


def test_trees_show_where_copies_differ(spark):
    all_ = blobs_of(spark, [f"t{k}" for k in range(300)])
    whole, part = bundles.digest_tree(all_), bundles.digest_tree(all_.filter(F.col("content") != F.lit("t7").cast("binary")))
    assert [r["prefix"] for r in bundles.differing_leaves(whole, part).collect()] == [sha256(b"t7").hexdigest()[:4]]
    assert bundles.differing_leaves(whole, bundles.digest_tree(all_.union(all_))).isEmpty()
    assert bundles.digest_tree(all_.limit(0)).isEmpty()


def objects_of(spark, texts, store="s"):
    return spark.createDataFrame([(f"KB-{k:08d}", f"{store}{k}", sha256(t.encode()).hexdigest()) for k, t in enumerate(texts, 1)], "object_id string, uuid string, content_hash string")


def test_bundle_gates(spark, tmp_path):
    texts = [f"t{k}" for k in range(20)]
    have, blobs = objects_of(spark, texts), blobs_of(spark, texts)
    path = str(tmp_path / "whole")
    assert bundles.export_bundle(have, blobs, path).isEmpty()
    refused = lambda *a, **k: {(r["refusal"], r["n"]) for r in bundles.check_bundle(spark, *a, **k).collect()}
    assert refused(path) == set()
    assert refused(path, objects_of(spark, texts[:5], "other"), blobs.limit(0)) == {("other lineage", 1)}
    ahead = objects_of(spark, [*texts, "new"])
    assert refused(path, ahead, blobs) == {("this store is ahead", 1)} and refused(path, ahead, blobs, force=True) == set()
    # without evidence only where all of it is
    bare = str(tmp_path / "bare")
    bundles.export_bundle(have, blobs, bare, evidence=False)
    assert {r[0] for r in refused(bare)} == {"missing blob", "leaf differs"} and refused(bare, have, blobs) == set()
    # a remote that is ahead, or another store, gets nothing
    assert [r["refusal"] for r in bundles.export_bundle(have, blobs, str(tmp_path / "no"), ahead, blobs).collect()] == ["remote is ahead"]
    assert not (tmp_path / "no").exists()
    against, new, all_blobs = bundles.apply_bundle(spark, path, have.limit(3), blobs.limit(3))
    assert against.isEmpty() and new.count() == all_blobs.count() == 20


def test_numbers_above_eight_digits_are_ahead(spark):
    old = spark.createDataFrame([("KB-99999999", "a", "h")], "object_id string, uuid string, content_hash string")
    new = old.union(spark.createDataFrame([("KB-100000000", "b", "h")], old.schema))
    assert [r["high_water"] for r in (bundles.manifest(old).first(), bundles.manifest(new).first())] == [99_999_999, 100_000_000]
