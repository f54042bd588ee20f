"""Provenance chains, citations, evidence packs and verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_provenance(provenance: DataFrame) -> DataFrame:
    """One row per version: the one with the greatest provenance_id."""
    cols = [c for c in provenance.columns if c != "version_id"]
    return provenance.groupBy("version_id").agg(F.max_by(F.struct(*cols), "provenance_id").alias("p")).select("version_id", "p.*")


def provenance_chain(objects: DataFrame, versions: DataFrame, provenance: DataFrame, blobs: DataFrame) -> DataFrame:
    """objects: object_id, current_version_id. versions: version_id, content_hash. provenance: provenance_id,
    version_id, source_object_id, evidence_hash. blobs: content_hash. Adds breaks (names of missing links) and
    complete. Several provenance rows of a version count as the latest one."""
    v = versions.select(F.col("version_id").alias("_v"), F.lit(True).alias("has_version"))
    p = latest_provenance(provenance).select(F.col("version_id").alias("_p"), "source_object_id", "evidence_hash")
    b = blobs.select(F.col("content_hash").alias("_b"), F.lit(True).alias("has_blob")).distinct()
    met = objects.join(v, objects["current_version_id"] == v["_v"], "left").join(p, F.col("current_version_id") == F.col("_p"), "left").join(b, F.col("evidence_hash") == F.col("_b"), "left")
    breaks = F.array_compact(F.array(
        F.when(F.col("has_version").isNull(), F.lit("no version")), F.when(F.col("_p").isNull(), F.lit("no provenance")),
        F.when(F.col("_p").isNotNull() & F.col("source_object_id").isNull(), F.lit("no source object")), F.when(F.col("_p").isNotNull() & F.col("has_blob").isNull(), F.lit("no evidence blob")),
    ))
    return met.select(*objects.columns, "source_object_id", "evidence_hash", breaks.alias("breaks"), (F.size(breaks) == 0).alias("complete"))


def cite(chain: DataFrame, edges: DataFrame) -> DataFrame:
    """object_id, status: COMPLETE, COMPLETE_VIA_PARENTS (all DERIVED_FROM sources are complete) or INCOMPLETE."""
    derived = edges.filter("relationship_type = 'DERIVED_FROM'").select(F.col("source_object").alias("object_id"), F.col("target_object").alias("_t"))
    parents = derived.join(chain.select(F.col("object_id").alias("_t"), F.col("complete").alias("_ok")), "_t", "left").groupBy("object_id").agg(F.count("*").alias("parents"), F.bool_and(F.coalesce("_ok", F.lit(False))).alias("parents_ok"))
    met = chain.select("object_id", "complete").join(parents, "object_id", "left")
    status = F.when(F.col("complete"), "COMPLETE").when(F.col("parents_ok"), "COMPLETE_VIA_PARENTS").otherwise("INCOMPLETE")
    return met.select("object_id", status.alias("status"), F.coalesce("parents", F.lit(0)).alias("parents"))


def coverage_gaps(objects: DataFrame, declared: DataFrame) -> DataFrame:
    """declared: source_id. Each source's objects and whether it was ever ingested."""
    have = objects.groupBy("source_id").agg(F.count("*").alias("n"))
    return declared.select("source_id").distinct().join(have, "source_id", "full_outer").select("source_id", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNotNull().alias("present"))


def coverage(objects: DataFrame, declared: DataFrame, dead_letters: DataFrame, urls: DataFrame) -> DataFrame:
    """objects: source_id, created_at, classification. declared, dead_letters, urls: source_id. Of each source: whether it
    is there, its objects, their span, how many are withheld, what failed, and its URLs."""
    have = objects.groupBy("source_id").agg(F.count("*").alias("n"), F.min("created_at").alias("first"), F.max("created_at").alias("last"), F.count_if(F.col("classification") == "RESTRICTED").alias("redacted"))
    per = lambda rows, name: rows.groupBy("source_id").agg(F.count("*").alias(name))
    met = declared.select("source_id").distinct().join(have, "source_id", "full_outer").join(per(dead_letters, "dead_letters"), "source_id", "full_outer").join(per(urls, "urls"), "source_id", "full_outer")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return met.select("source_id", F.col("n").isNotNull().alias("present"), zero("n"), "first", "last", zero("redacted"), zero("dead_letters"), zero("urls"))


def evidence(ranked: DataFrame, docs: DataFrame, chain: DataFrame, excerpt: int = 1200) -> DataFrame:
    """The evidence for each query: ranked objects with an excerpt and whether their chain is complete; no answer."""
    return ranked.select("query_id", "rank", "object_id", "score").join(docs.select("object_id", F.substring("body", 1, excerpt).alias("excerpt")), "object_id").join(chain.select("object_id", "complete"), "object_id", "left")


def record_answers(answers: DataFrame, objects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """answers: answer_id, text, sources array. Returns (synthesised objects, DERIVED_FROM edges to sources that exist)."""
    made = answers.select(F.col("answer_id").alias("object_id"), F.col("text").alias("body"), F.lit("SYNTHESIZED").alias("knowledge_state"), F.lit("UNVERIFIED").alias("decay_status"), F.lit("REQUIRES_HUMAN_REVIEW").alias("validation_status"))
    edges = answers.select(F.col("answer_id").alias("source_object"), F.explode("sources").alias("target_object")).distinct()
    edges = edges.join(objects.select(F.col("object_id").alias("target_object")), "target_object", "left_semi")
    return made, edges.withColumn("relationship_type", F.lit("DERIVED_FROM")).select("source_object", "target_object", "relationship_type")


def apply_verdicts(objects: DataFrame, verdicts: DataFrame) -> DataFrame:
    """verdicts: object_id, accept (boolean). A judged object gets a new version: accepted HUMAN_VALIDATED and CURRENT,
    rejected SYNTHESIZED and DISPUTED. Of several verdicts on an object, a rejection wins."""
    v = verdicts.groupBy("object_id").agg(F.bool_and("accept").alias("_a"))
    met = objects.join(v, "object_id", "left")
    state = F.when(F.col("_a"), "HUMAN_VALIDATED").when(~F.col("_a"), "SYNTHESIZED").otherwise(F.col("knowledge_state"))
    decay = F.when(F.col("_a"), "CURRENT").when(~F.col("_a"), "DISPUTED").otherwise(F.col("decay_status"))
    return met.withColumn("knowledge_state", state).withColumn("decay_status", decay).withColumn("version_num", F.col("version_num") + F.col("_a").isNotNull().cast("int")).drop("_a")
