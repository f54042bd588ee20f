"""Structured Streaming over append-only logs: windows, sessions, replay-safe logs and incremental ingestion."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def _timed(events: DataFrame, ts: str, watermark: str | None) -> DataFrame:
    """events with ts as a timestamp and, if they stream, a watermark. None: the stream has one already, and Spark
    allows no second one; ts must be a timestamp then."""
    if events.schema[ts].dataType.typeName() != "timestamp":
        events = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return events.withWatermark(ts, watermark) if events.isStreaming and watermark else events


def windowed_counts(events: DataFrame, size: str = "1 day", watermark: str | None = "1 hour", ts: str = "ts") -> DataFrame:
    """Events and users per tumbling window and type; also for a batch table, where watermarks do nothing. After
    dedup_stream the watermark is set: give None."""
    timed = _timed(events, ts, watermark)
    per = timed.groupBy(F.window(ts, size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return per.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def activity_sessions(events: DataFrame, gap: str = "30 minutes", watermark: str | None = "1 hour", ts: str = "ts") -> DataFrame:
    """Sessions of each user: their events with no pause of `gap` or more."""
    timed = _timed(events, ts, watermark)
    per = timed.groupBy("user_id", F.session_window(ts, gap).alias("s")).agg(F.count("*").alias("n"))
    return per.select("user_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")


def dedup_stream(events: DataFrame, key: str = "event_id", watermark: str = "1 day", ts: str = "ts") -> DataFrame:
    """A log whose replayed events are dropped; a stream forgets a key when the watermark has passed it."""
    timed = _timed(events, ts, watermark)
    return timed.dropDuplicatesWithinWatermark([key]) if timed.isStreaming else timed.dropDuplicates([key])


def late_rows(events: DataFrame, watermark_ts: DataFrame, ts: str = "ts") -> tuple[DataFrame, DataFrame]:
    """(in time, late) against a one-row table with the watermark. Rows without a time are late: no window takes them."""
    met = events.join(F.broadcast(watermark_ts.select(F.col("watermark").alias("_w")).limit(1)))  # one row
    intime = F.coalesce(F.col(ts) >= F.col("_w"), F.lit(False))
    return met.filter(intime).drop("_w"), met.filter(~intime).drop("_w")


def quarantine_late(events: DataFrame, dead_letters: str, checkpoint: str, ingest: Callable[[DataFrame, int], None], delay: str = "1 day", ts: str = "ts") -> StreamingQuery:
    """Feeds a stream to ingest, batch by batch, without its late rows; those go to the folder dead_letters with their
    batch. Late: more than `delay` before the newest row of the earlier batches, whose time a marker folder keeps."""

    def split(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        marks = f"{checkpoint}/newest"
        # a marker per batch: a batch that is repeated after a failure sees the same earlier ones
        spark.createDataFrame([], "batch long, newest timestamp").write.mode("append").parquet(marks)
        mark = spark.read.schema("batch long, newest timestamp").parquet(marks).filter(F.col("batch") < number).agg((F.max("newest") - F.expr(f"interval {delay}")).alias("watermark"))
        mark = mark.select(F.coalesce("watermark", F.lit("0001-01-01").cast("timestamp")).alias("watermark"))
        intime, late = late_rows(batch, mark, ts)
        late.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{dead_letters}/run={number}")
        ingest(intime, number)
        batch.agg(F.lit(number).cast("long").alias("batch"), F.max(F.col(ts).cast("timestamp")).alias("newest")).write.mode("append").parquet(marks)

    return events.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(split).start()


def stream_ingest(spark: SparkSession, path: str, schema: str, checkpoint: str, ingest: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Feeds new files of a folder to an idempotent batch ingestion; the checkpoint resumes where it stopped."""
    return spark.readStream.schema(schema).parquet(path).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(ingest).start()
