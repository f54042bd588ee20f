"""Sinks: content-addressed blobs, sorted mirrors, snapshots, published indexes, event logs and quarantine."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# Fixed vocabulary of the event log.
OPERATIONS = ["ACQUIRED", "IMPORTED", "NORMALIZED", "CLASSIFIED", "ENRICHED", "REVIEWED", "VALIDATED", "MODIFIED", "MERGED", "SPLIT", "SUPERSEDED", "ARCHIVED", "RESTORED", "DELETED"]


def store_blobs(files: DataFrame, path: str, known: DataFrame | None = None) -> DataFrame:
    """files: content. Appends bytes that aren't stored yet, under two characters of their hash; returns the hashes and
    sizes that this call wrote. known: content_hash of what is stored. Null content is nothing."""
    new = files.filter("content is not null").select(F.sha2("content", 256).alias("content_hash"), "content", F.length("content").alias("bytes")).dropDuplicates(["content_hash"])
    if known is not None:
        new = new.join(known.select("content_hash"), "content_hash", "left_anti")
    # each call writes a folder of its own, so what it wrote can be read back however often the result is asked for
    run = uuid.uuid4().hex
    new.withColumns({"run": F.lit(run), "prefix": F.substring("content_hash", 1, 2)}).write.mode("append").partitionBy("run", "prefix").parquet(path)
    stored = files.sparkSession.read.schema("content_hash string, content binary, bytes int, run string, prefix string").parquet(path)
    return stored.filter(F.col("run") == run).select("content_hash", "bytes")


def export_mirror(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Every table as sorted JSON lines, and a manifest of rows and bytes, which are counted while they are written."""
    spark = next(iter(tables.values())).sparkSession
    rows = []
    for name, df in sorted(tables.items()):
        line = df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value")).orderBy("value")
        seen = Observation()
        line.observe(seen, F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("value") + 1), F.lit(0)).alias("bytes")).write.mode("overwrite").text(f"{path}/{name}")
        rows.append((name, seen.get["n"], seen.get["bytes"]))
    return spark.createDataFrame(rows, "table string, n_rows long, bytes long")


def snapshot(tables: dict[str, DataFrame], path: str, tier: str) -> DataFrame:
    """A copy of every table under a path that must be new; its manifest is unproven."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in sorted(tables.items()):
        df.write.mode("errorifexists").parquet(f"{path}/{name}")
    rows = [(tier, name, spark.read.parquet(f"{path}/{name}").count(), False) for name in sorted(tables)]
    return spark.createDataFrame(rows, "tier string, table string, n_rows long, proven boolean")


def publish_index(index: dict[str, DataFrame], path: str, version: str) -> str:
    """Writes the index beside the old one, then the pointer that readers follow."""
    for name, df in index.items():
        df.write.parquet(f"{path}/{version}/{name}")
    spark = next(iter(index.values())).sparkSession
    spark.createDataFrame([(version, "FRESH")], "version string, status string").coalesce(1).write.mode("overwrite").parquet(f"{path}/_current")
    return f"{path}/{version}"


def current_index(spark: SparkSession, path: str, name: str) -> DataFrame:
    version = spark.read.parquet(f"{path}/_current").first()["version"]
    return spark.read.parquet(f"{path}/{version}/{name}")


def split_failures(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of a parser (…, error): the good ones, and the others for quarantine."""
    return parsed.filter("error is null").drop("error"), parsed.filter("error is not null")


def run_manifest(outcomes: DataFrame, failed: DataFrame) -> DataFrame:
    """created, versioned, unchanged, failed and the run's status."""
    n = outcomes.agg(*(F.count_if(F.col("outcome") == o).alias(o) for o in ("created", "versioned", "unchanged")))
    met = n.join(F.broadcast(failed.agg(F.count("*").alias("failed"))))  # one row each
    good = F.col("created") + F.col("versioned") + F.col("unchanged")
    status = F.when((good == 0) & (F.col("failed") == 0), "SKIPPED").when(F.col("failed") == 0, "COMPLETED").when(good == 0, "FAILED").otherwise("PARTIALLY_COMPLETED")
    return met.withColumn("status", status)


def append_events(events: DataFrame, new: DataFrame) -> DataFrame:
    """The log with new rows whose operation is in the vocabulary; an event_id that is there already adds nothing."""
    good = new.filter(F.col("operation").isin(OPERATIONS)).join(events.select("event_id"), "event_id", "left_anti")
    return events.unionByName(good.dropDuplicates(["event_id"]))
