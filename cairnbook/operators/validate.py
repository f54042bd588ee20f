"""Invariants of the store: each check returns one row (check, severity, violations)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnbook.operators.secretscan import scan_body


def check(violations: DataFrame, name: str, severity: str = "ERROR") -> DataFrame:
    n = violations.agg(F.count("*").alias("violations"))
    status = F.when(F.col("violations") == 0, "OK").otherwise(severity)
    return n.select(F.lit(name).alias("check"), F.col("violations"), status.alias("status"))


def no_current_version(objects: DataFrame) -> DataFrame:
    return objects.filter("current_version_id is null")


def versions_without_provenance(versions: DataFrame, provenance: DataFrame) -> DataFrame:
    return versions.join(provenance.select("version_id"), "version_id", "left_anti")


def broken_chains(versions: DataFrame) -> DataFrame:
    """Versions whose parent isn't there, or later versions without a parent."""
    parents = versions.select(F.col("version_id").alias("parent_version_id"))
    return versions.filter("parent_version_id is not null").join(parents, "parent_version_id", "left_anti").select("version_id").unionByName(versions.filter("version_num > 1 and parent_version_id is null").select("version_id"))


def objects_without_events(objects: DataFrame, events: DataFrame) -> DataFrame:
    return objects.join(events.select("object_id"), "object_id", "left_anti")


def missing_accounts(source_objects: DataFrame, accounts: DataFrame) -> DataFrame:
    """Rows without an account under a source that has accounts."""
    return source_objects.filter("account_id is null").join(accounts.filter("account_id is not null").select("source_id"), "source_id", "left_semi")


def shared_across_accounts(source_objects: DataFrame) -> DataFrame:
    return source_objects.groupBy("object_id").agg(F.countDistinct(F.coalesce("account_id", F.lit("~"))).alias("n")).filter("n > 1")


def unlisted_values(rows: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """Rows whose value an enumeration doesn't have; null is fine."""
    return rows.filter(~F.col(column).isin(allowed))


def repeated_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def aliases_without_links(objects: DataFrame, links: DataFrame) -> DataFrame:
    return objects.filter("is_duplicate_of is not null").join(links.select(F.col("alias").alias("object_id")), "object_id", "left_anti")


def blob_states(blobs: DataFrame, files: DataFrame) -> DataFrame:
    """blobs: content_hash. files: content_hash (by name), content (bytes). Each blob is ok, missing or corrupt after
    its bytes are hashed again."""
    found = files.select(F.col("content_hash").alias("_h"), F.sha2("content", 256).alias("_real"))
    met = blobs.join(found, blobs["content_hash"] == found["_h"], "left")
    state = F.when(F.col("_h").isNull(), "missing").when(F.col("_real") == F.col("_h"), "ok").otherwise("corrupt")
    return met.select("content_hash", state.alias("state"))


def index_stale_since_redaction(events: DataFrame, indexes: DataFrame) -> DataFrame:
    """Stale indexes, if anything was ever redacted."""
    redacted = events.filter("operation = 'redacted'").limit(1).select(F.lit(True).alias("_r"))
    return indexes.filter("status = 'STALE'").join(F.broadcast(redacted))  # one row at most


def passed(checks: DataFrame) -> DataFrame:
    return checks.agg(F.bool_and(F.col("status") != "ERROR").alias("passed"))


def open_conflicts(conflicts: DataFrame) -> DataFrame:
    """What is recorded and not resolved; a fact to be seen, not an error."""
    return conflicts.filter("status = 'OPEN'")


def values_in_registry(registry: DataFrame) -> DataFrame:
    """Rows of the credential registry (storage_location) that hold a value where a place should stand."""
    at = F.col("storage_location")
    return registry.filter(at.contains("BEGIN") | at.startswith("sk-") | at.startswith("ghp_"))


def secrets_in_bodies(objects: DataFrame, versions: DataFrame) -> DataFrame:
    """object_id and kinds of the objects whose current version (current_version; version_id, body) holds a secret."""
    now = objects.select("object_id", F.col("current_version").alias("version_id")).join(versions.select("version_id", "body"), "version_id")
    return now.select("object_id", scan_body(F.col("body")).alias("kinds")).filter(F.size("kinds") > 0)


def stale_indexes(indexes: DataFrame) -> DataFrame:
    return indexes.filter("status = 'STALE'")
