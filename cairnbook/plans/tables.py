"""The driver's tables seen as the canonical tables of a knowledge store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnbook.functions import text as tx
from cairnbook.functions.urls import canonicalize_url

CONVERSATIONS_FROM, MESSAGES_FROM = 50_000_000, 60_000_000
_TIERS = ["PRIMARY SOURCE", "DIRECT PROJECT ARTIFACT", "COMMUNITY SOURCE", "AI-GENERATED", "UNKNOWN"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as File objects: one row each, with the current version's body and hash."""
    d = read(spark, sf_dir, "documents")
    tier = F.element_at(F.array(*map(F.lit, _TIERS)), (F.col("doc_id") % len(_TIERS) + 1).cast("int"))
    return d.select(
        "doc_id",
        tx.object_id(F.col("doc_id") + 1).alias("object_id"),
        F.lit("File").alias("object_class"),
        F.col("source").alias("source_id"),
        F.col("lang").alias("account_id"),
        F.concat(F.lit("/store/"), "source", F.lit("/"), "lang", F.lit("/doc"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("native_path"),
        F.col("text").alias("body"),
        F.sha2("text", 256).alias("content_hash"),
        F.col("n_chars").alias("bytes"),
        tier.alias("authority"),
        F.lit("CURRENT").alias("decay_status"),
        F.lit(None).cast("string").alias("is_duplicate_of"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as Message objects, with the conversation they belong to."""
    c = read(spark, sf_dir, "conversations")
    authority = F.when(F.col("role") == "user", "PRIMARY SOURCE").when(F.col("role") == "assistant", "AI-GENERATED").otherwise("UNKNOWN")
    return c.select(
        "conv_id", "turn", "role", F.col("text").alias("body"),
        tx.object_id(F.col("conv_id") * 1000 + F.col("turn") + MESSAGES_FROM).alias("object_id"),
        tx.object_id(F.col("conv_id") + CONVERSATIONS_FROM).alias("conversation_id"),
        authority.alias("authority"),
    )


def relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PART_OF from each message to its conversation, REPLIES_TO to the turn before it."""
    m = messages(spark, sf_dir)
    part = m.select(F.col("object_id").alias("source_object"), F.col("conversation_id").alias("target_object"), F.lit("PART_OF").alias("relationship_type"))
    before = m.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("object_id").alias("target_object"))
    reply = m.join(before, ["conv_id", "turn"]).select(F.col("object_id").alias("source_object"), "target_object", F.lit("REPLIES_TO").alias("relationship_type"))
    return part.unionByName(reply)


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with their canonical URL."""
    p = read(spark, sf_dir, "pages")
    return p.select("page_id", "url", canonicalize_url(F.col("url")).alias("c")).select("page_id", "url", "c.*")


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as visits: the user's page is the one of the same number."""
    e = read(spark, sf_dir, "events")
    p = urls(spark, sf_dir).filter("normalized_url is not null").select(F.col("page_id").alias("user_id"), "normalized_url", "domain", "url")
    return e.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("visit_kind")).join(p, "user_id")
