"""Tables that must not be computed twice, and folders that all machines share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, which a cluster must not do, one for local runs."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir("/tmp/cairnbook-checkpoints")
    return context.getCheckpointDir().rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """The path of a folder below the shared one that nothing else uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def fixed(df: DataFrame) -> DataFrame:
    """df as it is now, in the folder that the cluster shares (spark.checkpoint.dir): what depends on where rows lie, or
    on a loop, gives the same rows each time it is read, also after an executor is lost."""
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df as it is now, as Parquet in the shared folder. Like `fixed`, but columns that a reader leaves out aren't read, and
    its size is known, so Spark itself decides whether to broadcast it."""
    path = new_folder(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str, times: int = 4) -> DataFrame:
    """df dealt over all cores by its keys: a file of one row group, or few files, would be the work of as many tasks. Counts
    per key that follow find their rows together."""
    spark = df.sparkSession
    return df.repartition(max(times * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)
