"""Exact duplicates and URL variants: links between objects, never deletions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnbook.functions import text as tx
from cairnbook.functions.urls import schemeless


def exact_duplicates(objects: DataFrame) -> DataFrame:
    """Groups of live objects with one content hash: content_hash, canonical, n, bytes_each. Partial aggregation keeps a
    group that holds a third of all rows to one row a task. Null hashes form no group."""
    live = objects.filter("is_duplicate_of is null and content_hash is not null")
    return live.groupBy("content_hash").agg(F.min_by("object_id", tx.id_order(F.col("object_id"))).alias("canonical"), F.count("*").alias("n"), F.floor(F.sum("bytes") / F.count("*")).alias("bytes_each")).filter("n > 1")


def url_variants(urls: DataFrame) -> DataFrame:
    """Canonical URLs that differ in their scheme only: key, n, first."""
    u = urls.filter("normalized_url is not null").select("normalized_url").distinct()
    return u.groupBy(schemeless(F.col("normalized_url")).alias("key")).agg(F.count("*").alias("n"), F.min("normalized_url").alias("first")).filter("n > 1")


def link_duplicates(objects: DataFrame) -> DataFrame:
    """alias, canonical (least object_id of the group), kind, confidence for every redundant object."""
    groups = exact_duplicates(objects).select("content_hash", "canonical")
    return objects.filter("is_duplicate_of is null").join(groups, "content_hash").filter("object_id <> canonical").select(F.col("object_id").alias("alias"), "canonical", F.lit("exact").alias("kind"), F.lit(1.0).alias("confidence"))


def with_aliases(objects: DataFrame, links: DataFrame) -> DataFrame:
    """Objects with is_duplicate_of set from new links; the first link of an object wins."""
    one = links.groupBy(F.col("alias").alias("object_id")).agg(F.min_by("canonical", tx.id_order(F.col("canonical"))).alias("_c"))
    return objects.join(one, "object_id", "left").withColumn("is_duplicate_of", F.coalesce("is_duplicate_of", "_c")).drop("_c")


def reclaimable(groups: DataFrame) -> DataFrame:
    return groups.agg(F.count("*").alias("n_groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("redundant"), F.coalesce(F.sum(F.col("bytes_each") * (F.col("n") - 1)), F.lit(0)).cast("long").alias("bytes"))


def exclusive_cost(objects: DataFrame, excluded: Column) -> DataFrame:
    """Bytes of content that only objects under an exclusion rule hold, against content that others share."""
    per = objects.groupBy("content_hash").agg(F.bool_and(excluded).alias("only"), F.bool_or(excluded).alias("some"), F.max("bytes").alias("bytes"))
    kind = F.when(F.col("only"), "exclusive").when(F.col("some"), "shared").otherwise("kept")
    return per.groupBy(kind.alias("kind")).agg(F.count("*").alias("blobs"), F.sum("bytes").alias("bytes"))
