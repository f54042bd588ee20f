"""Replication, backup and drills as comparisons of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnbook.functions import text as tx


def store_manifest(objects: DataFrame, blobs: DataFrame) -> DataFrame:
    """lineage (uuid of the least object), counts and the id high-water mark."""
    o = objects.agg(F.min_by("uuid", tx.id_order(F.col("object_id"))).alias("lineage"), F.count("*").alias("n_objects"), F.max_by("object_id", tx.id_order(F.col("object_id"))).alias("high_water"))
    return o.join(F.broadcast(blobs.agg(F.count("*").alias("n_blobs"), F.sum("bytes").alias("bytes"))))  # one row each


def blob_plan(local: DataFrame, remote: DataFrame) -> DataFrame:
    """content_hash, bytes, action: send, remote_only or both. Either side's repeats count once."""
    a = local.groupBy("content_hash").agg(F.max("bytes").alias("_a"))
    b = remote.groupBy("content_hash").agg(F.max("bytes").alias("_b"))
    met = a.join(b, "content_hash", "full_outer")
    action = F.when(F.col("_b").isNull(), "send").when(F.col("_a").isNull(), "remote_only").otherwise("both")
    return met.select("content_hash", F.coalesce("_a", "_b").alias("bytes"), action.alias("action"))


def replication_plan(local: DataFrame, remote: DataFrame) -> DataFrame:
    """action, blobs, bytes."""
    return blob_plan(local, remote).groupBy("action").agg(F.count("*").alias("blobs"), F.sum("bytes").alias("bytes"))


def refusals(local: DataFrame, remote: DataFrame, force: bool = False) -> DataFrame:
    """Reasons not to replicate, from two manifests: another lineage, or a remote that is ahead (unless forced)."""
    met = local.select(F.col("lineage").alias("l"), F.col("high_water").alias("lh")).join(F.broadcast(remote.select(F.col("lineage").alias("r"), F.col("high_water").alias("rh"))))  # one row each
    ahead = F.when((tx.id_order(F.col("rh").cast("string")) > tx.id_order(F.col("lh").cast("string"))) & F.lit(not force), F.lit("remote is ahead"))
    return met.select(F.explode(F.array_compact(F.array(F.when(F.col("l") != F.col("r"), F.lit("other lineage")), ahead))).alias("refusal"))


def export_delta(local: DataFrame, remote: DataFrame) -> DataFrame:
    return local.join(remote.select("content_hash").distinct(), "content_hash", "left_anti")


def replica_state(local: DataFrame, remote: DataFrame, base: DataFrame) -> DataFrame:
    """Three-way state of every path from (path, hash) tables: SAME, LOCAL_NEWER, REMOTE_NEWER, CONFLICT, and deletions."""
    sides = [t.select("path", F.col("hash").alias(n)) for t, n in ((local, "l"), (remote, "r"), (base, "b"))]
    met = sides[0].join(sides[1], "path", "full_outer").join(sides[2], "path", "full_outer")
    l, r, b = F.col("l"), F.col("r"), F.col("b")
    state = F.when(l.eqNullSafe(r), F.lit("SAME")).when(r.eqNullSafe(b), F.when(l.isNull(), "LOCAL_DELETED").otherwise("LOCAL_NEWER")).when(l.eqNullSafe(b), F.when(r.isNull(), "REMOTE_DELETED").otherwise("REMOTE_NEWER")).otherwise("CONFLICT")
    return met.select("path", state.alias("state"))


def verify_bundle(bundle: DataFrame, referenced: DataFrame) -> DataFrame:
    """bundle: content_hash, content. referenced: content_hash. Refusals: corrupt and missing blobs, with counts."""
    corrupt = bundle.filter(F.sha2("content", 256) != F.col("content_hash")).agg(F.count("*").alias("n")).select(F.lit("corrupt blob").alias("refusal"), "n")
    missing = referenced.join(bundle.select("content_hash"), "content_hash", "left_anti").agg(F.count("*").alias("n")).select(F.lit("missing blob").alias("refusal"), "n")
    return corrupt.unionByName(missing).filter("n > 0")


def restore_drill(snapshot: dict[str, DataFrame], live: dict[str, DataFrame]) -> DataFrame:
    """Rows of each table in the snapshot and live, and what a restore would lose."""
    out = None
    for name in sorted(snapshot):
        a, b = snapshot[name].agg(F.count("*").alias("snapshot_rows")), live[name].agg(F.count("*").alias("live_rows"))
        one = a.join(F.broadcast(b)).select(F.lit(name).alias("table"), "snapshot_rows", "live_rows", F.greatest(F.col("live_rows") - F.col("snapshot_rows"), F.lit(0)).alias("lost"))  # one row each
        out = one if out is None else out.unionByName(one)
    return out


def recovery_position(snapshots: DataFrame, tiers: DataFrame) -> DataFrame:
    """snapshots: tier, taken_at, proven, with_evidence. tiers: tier. One row per tier, also without a snapshot."""
    per = snapshots.groupBy("tier").agg(F.count("*").alias("n"), F.max("taken_at").alias("newest"), F.max(F.when(F.col("proven"), F.col("taken_at"))).alias("last_proven"), F.count_if("with_evidence").alias("with_evidence"))
    out = tiers.select("tier").join(per, "tier", "left")
    warning = F.when(F.col("n").isNull(), "no snapshot").when(F.col("last_proven").isNull(), "never proven")
    return out.select("tier", F.coalesce("n", F.lit(0)).alias("n"), "newest", "last_proven", F.coalesce("with_evidence", F.lit(0)).alias("with_evidence"), warning.alias("warning"))


def interrupted_writes(listing: DataFrame, blobs: DataFrame) -> DataFrame:
    """listing: path. Fragments '<hash>.tmp-…' and whether they may go: only if the final blob is registered."""
    hash_ = F.regexp_extract("path", r"([0-9a-f]{64})\.tmp-[^/]*$", 1)
    frag = listing.withColumn("content_hash", hash_).filter("content_hash <> ''")
    return frag.join(blobs.select("content_hash", F.lit(True).alias("_ok")).distinct(), "content_hash", "left").select("path", "content_hash", F.coalesce("_ok", F.lit(False)).alias("prunable"))
