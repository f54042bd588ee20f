"""Ingestion of batches into a store of tables that readers see whole or not at all.

A batch of items becomes rows of five tables (source_object, object, object_version, provenance, event) and of visits, all
under its number. The last thing that a batch writes is its commit row; readers take only rows of committed batches, and
of source_object and object the newest row of a key. A batch that died halfway is written anew under the same number; one
that is committed already is not looked at again, so a stream may replay it. Nothing but the commit rows, one per batch,
reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cairnbook.functions import text as tx
from cairnbook.functions.lineage import fixed, stored
from cairnbook.operators.canonical import NATURAL_KEY, allocate_ids, ingest_outcomes

_KEY = "source_id string, account_id string, native_id string"
SCHEMAS = {
    "source_object": f"source_object_id string, {_KEY}, object_id string, content_hash string, version_num int, native_path string, native_url string, acquired_at timestamp, job string",
    "object": "object_id string, object_class string, title string, authority string, lifecycle_state string, current_version string, updated_at timestamp",
    "object_version": "version_id string, object_id string, version_num int, parent_version_id string, change_type string, change_reason string, content_hash string, body string, created_at timestamp",
    "provenance": f"provenance_id string, object_id string, version_id string, source_object_id string, {_KEY}, original_path string, source_url string, original_hash string, acquired_at timestamp",
    "event": "event_id string, object_id string, operation string, source string, previous_state string, new_state string, reason string, job string, timestamp timestamp",
    "visit": "normalized_url string, domain string, ts timestamp, title string",
}
_COMMIT = "batch long, high_water long, created long, versioned long, unchanged long"
_KEYS = {"source_object": NATURAL_KEY, "object": ["object_id"]}
#: Columns that an item may lack.
_OPTIONAL = {"object_class": "File", "title": None, "body": None, "native_path": None, "native_url": None, "authority": None, "seq": 0}


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def commits(spark: SparkSession, path: str) -> DataFrame:
    """One row per committed batch: its number, the highest object number so far, and what it did."""
    return spark.read.schema(_COMMIT).parquet(f"{path}/_commits") if _exists(spark, f"{path}/_commits") else spark.createDataFrame([], _COMMIT)


def read_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """The rows of all committed batches, with their batch; of source_object and object only the newest of each key."""
    schema = f"{SCHEMAS[table]}, batch long"
    if not _exists(spark, f"{path}/{table}"):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(f"{path}/{table}").join(commits(spark, path).select("batch"), "batch", "left_semi")
    if table not in _KEYS:
        return rows
    keys = _KEYS[table]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), "batch").alias("_r"))
    return newest.select(*keys, "_r.*")


def ingest_batch(spark: SparkSession, path: str, items: DataFrame, batch: int, at: str, job: str = "ingest", visits: DataFrame | None = None) -> dict[str, int]:
    """items: natural key, content_hash and what else _OPTIONAL names. at: the time that new rows bear. visits:
    normalized_url, domain, ts, title; those that the store has already (by URL and time) are not added again. Returns
    what the batch did, or had done if it is committed.

    Null parts of a key match null. A key that occurs again in the batch is versioned on in the order of seq, then hash;
    an empty batch commits nothing new."""
    done = {r["batch"]: r for r in commits(spark, path).collect()}
    if batch in done:
        return done[batch].asDict()
    high = max((r["high_water"] for r in done.values()), default=0)
    for name, default in _OPTIONAL.items():
        if name not in items.columns:
            items = items.withColumn(name, F.lit(default).cast("int" if name == "seq" else "string"))
    heads = read_table(spark, path, "source_object").select(*NATURAL_KEY, "object_id", "content_hash", "version_num")
    # bodies wait beside: only the rows that are written as versions fetch theirs, by the number of the row
    items = stored(items.withColumn("_row", F.monotonically_increasing_id()))
    outcomes = ingest_outcomes(items.drop("body").withColumn("seq", F.struct("seq", "content_hash")), heads)
    name = F.concat_ws("\x00", *[F.coalesce(F.col(k).cast("string"), F.lit("\x01")) for k in NATURAL_KEY])
    outcomes = fixed(outcomes.withColumn("_name", name))
    new = allocate_ids(outcomes.filter("outcome = 'created'").select("_name"), "_name", high).withColumnRenamed("object_id", "_new")
    when = F.lit(at).cast("timestamp")
    named = outcomes.join(new, "_name", "left").withColumn("object_id", F.coalesce("object_id", "_new"))
    changed = fixed(named.filter("outcome <> 'unchanged'").withColumns({
        "version_id": tx.version_id(F.col("object_id"), F.col("new_version")), "source_object_id": F.concat(F.lit("SO-"), F.substring_index("object_id", "-", -1)),
        "_first": F.col("outcome") == "created", "acquired_at": when, "job": F.lit(job),
    }))
    last = changed.groupBy("object_id").agg(F.max_by(F.struct(*changed.columns), "new_version").alias("_r")).select("_r.*")
    pick = lambda first, later: F.when(F.col("_first"), first).otherwise(later)
    made = {
        "source_object": last.withColumn("version_num", F.col("new_version")),
        "object": last.withColumns({"lifecycle_state": F.lit("ACQUIRED"), "current_version": F.col("version_id"), "updated_at": when}),
        "object_version": changed.join(items.select("_row", "body"), "_row").withColumns({
            "version_num": F.col("new_version"), "parent_version_id": F.when(F.col("new_version") > 1, tx.version_id(F.col("object_id"), F.col("new_version") - 1)), "created_at": when,
            "change_type": pick("imported", "normalized"), "change_reason": pick("initial acquisition", "source content changed since last acquisition"),
        }),
        "provenance": changed.withColumns({"provenance_id": F.concat(F.lit("PRV-"), "version_id"), "original_path": F.col("native_path"), "source_url": F.col("native_url"), "original_hash": F.col("content_hash")}),
        "event": changed.withColumns({
            "event_id": F.concat(F.lit("EVT-"), "version_id"), "operation": pick("ACQUIRED", "MODIFIED"), "source": F.col("source_id"), "previous_state": F.when(~F.col("_first"), "ACQUIRED"),
            "new_state": F.lit("ACQUIRED"), "reason": F.when(~F.col("_first"), "content hash changed"), "timestamp": when,
        }),
    }
    if visits is not None:
        seen = read_table(spark, path, "visit").select("normalized_url", "ts")
        made["visit"] = visits.filter("normalized_url is not null").join(seen, ["normalized_url", "ts"], "left_anti").groupBy("normalized_url", "ts").agg(F.max("domain").alias("domain"), F.max("title").alias("title"))
    for table, rows in made.items():
        write_table(rows, table, f"{path}/{table}/batch={batch}")
    n = outcomes.groupBy("outcome").count()
    counts = {r["outcome"]: r["count"] for r in n.collect()}
    row = {"batch": batch, "high_water": high + counts.get("created", 0), **{o: counts.get(o, 0) for o in ("created", "versioned", "unchanged")}}
    spark.createDataFrame([tuple(row.values())], _COMMIT).coalesce(1).write.mode("append").parquet(f"{path}/_commits")
    return row


def write_table(rows: DataFrame, table: str, path: str) -> None:
    names = [c.split(" ")[0] for c in SCHEMAS[table].split(", ")]
    rows.select(*names).write.mode("overwrite").parquet(path)


def ingest_stream(events: DataFrame, path: str, checkpoint: str, at: str, items: Callable[[DataFrame], DataFrame], job: str = "stream") -> StreamingQuery:
    """Every micro-batch of a stream is one batch of the store, under its own number: one that is replayed after a crash
    finds itself committed, or finishes what it left. items makes rows of the store's items from those of the stream."""

    def feed(rows: DataFrame, number: int) -> None:
        ingest_batch(rows.sparkSession, path, items(rows), number, at, job)

    return events.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(feed).start()
