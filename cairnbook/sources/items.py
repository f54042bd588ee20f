"""The common output of all scans, and helpers that they share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ITEM = ["source_id", "account_id", "native_id", "object_class", "title", "body", "content_hash", "native_path", "native_url", "created_at", "modified_at", "raw_metadata"]


def item(source_id: str, account: Column | None, native_id: Column, object_class: Column | str, title: Column | None = None, body: Column | None = None, content_hash: Column | None = None, path: Column | None = None, url: Column | None = None, created: Column | None = None, modified: Column | None = None, metadata: Column | None = None) -> list[Column]:
    """Columns of the item shape; what a source doesn't know is null, and the hash is that of title and body."""
    text = lambda c: (F.lit(None) if c is None else c).cast("string")
    stamp = lambda c: (F.lit(None) if c is None else c).cast("timestamp")
    digest = content_hash if content_hash is not None else F.sha2(F.concat_ws("\x00", F.coalesce(text(title), F.lit("")), F.coalesce(text(body), F.lit(""))), 256)
    kind = F.lit(object_class) if isinstance(object_class, str) else object_class
    values = [F.lit(source_id), text(account), text(native_id), kind, text(title), text(body), digest, text(path), text(url), stamp(created), stamp(modified), text(metadata)]
    return [v.alias(n) for v, n in zip(values, ITEM, strict=True)]


def with_account(files: DataFrame, identities: DataFrame, path: str = "path") -> DataFrame:
    """files with account_id from identities (path_prefix, account_id): the longest prefix wins, none is null. The
    identities are declared by hand, a few rows; Spark broadcasts them if they are."""
    met = files.join(identities, F.startswith(files[path], identities["path_prefix"]), "left")
    cols = [c for c in files.columns]
    return met.groupBy(*cols).agg(F.max_by("account_id", F.length("path_prefix")).alias("account_id"))


def identity_guard(messages: DataFrame, minimum: float = 0.05) -> DataFrame:
    """messages: mailbox, addresses, identity. Whether enough of a mailbox's messages carry its owner's address."""
    hit = F.contains(F.lower("addresses"), F.lower("identity")).cast("double")
    per = messages.groupBy("mailbox").agg(F.count("*").alias("total"), F.sum(F.coalesce(hit, F.lit(0.0))).cast("long").alias("hits"))
    return per.withColumn("ratio", F.col("hits") / F.col("total")).withColumn("ok", F.col("ratio") >= minimum)


def export_completeness(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """Files that a manifest promises and the listing (name) doesn't have."""
    return manifest.select("name").distinct().join(listing.select("name"), "name", "left_anti")


def loud_scan(listing: DataFrame, patterns: DataFrame) -> DataFrame:
    """pattern, n: how many listed paths each expected pattern (a regular expression) meets; zero is a finding."""
    met = patterns.select("pattern").distinct().join(listing.select("path"), F.expr("path rlike pattern"), "left")
    return met.groupBy("pattern").agg(F.count("path").alias("n"))


def dataset_tag(files: DataFrame) -> DataFrame:
    """dataset, tag: twelve hex digits that name a set of files by content. A dataset's files are few."""
    named = files.groupBy("dataset").agg(F.array_sort(F.collect_list(F.concat_ws(":", "name", "content_hash"))).alias("n"))
    return named.select("dataset", F.substring(F.sha2(F.array_join("n", "|"), 256), 1, 12).alias("tag"))
