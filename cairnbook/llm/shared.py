"""Helpers that several training-data operators use: intermediate tables, salted joins, word hashing."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Spark's own name for the text column inside operators; input columns of other names pass through untouched.
SALTS = 16


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); unset only in local tests."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    at = spark.sparkContext.getCheckpointDir()
    if at is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        spark.sparkContext.setCheckpointDir("/tmp/cairnbook-checkpoints")
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def materialise(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage ends there, and a lost executor costs
    only a new read. Tables of whole texts take less of the disk with the codec zstd."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    if (made := _made.get()) is not None:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Lists the tables that materialise() writes inside; at the end those are deleted that were left in the list."""
    made: list[str] = []
    token = _made.set(made)
    try:
        yield made
    finally:
        _made.reset(token)
        for path in made:
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(df: DataFrame) -> None:
    """Deletes the files of a table made by materialise() that nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        delete(df.sparkSession, folder)


def salted_left_join(rows: DataFrame, small: DataFrame, on: list[str], salts: int = SALTS) -> DataFrame:
    """Left join whose left side may hold a third of its rows under one key: those rows go to `salts` places, and
    each row of the right side (one per key) is copied to all of them. Null keys match null keys. The right side grows
    with the input, and its files say little of its size in memory: it is never broadcast."""
    left = rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    for c in on:
        right = right.withColumnRenamed(c, f"_r_{c}")
    met = F.lit(True)
    for c in on:
        met = met & left[c].eqNullSafe(right[f"_r_{c}"])
    joined = left.join(right.hint("merge"), met & (left["_salt"] == right["_salt"]), "left")
    return joined.drop(left["_salt"]).drop(right["_salt"]).drop(*[f"_r_{c}" for c in on])


def bounded(df: DataFrame) -> DataFrame:
    """df, after the session's Arrow batches were set to fewer rows if nobody has set them: rows here hold whole texts,
    and a worker should hold few of them at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if df.sparkSession.conf.get(name) == "10000":
        df.sparkSession.conf.set(name, "1000")
    return df


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that the column holds about `limit` bytes at most, or one row."""
    for batch in batches:
        at, rows = 0, batch.num_rows
        if not rows:
            continue
        column_data = batch.column(column)
        wide = column_data.cast(pa.large_binary() if pa.types.is_binary(column_data.type) else pa.large_string())
        ends = np.frombuffer(wide.buffers()[1], dtype=np.int64, count=rows + 1 + wide.offset)[wide.offset:]
        while at < rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def utf8_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty texts."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    ends = np.frombuffer(column.buffers()[1], dtype=np.int64, count=n + 1 + column.offset)[column.offset:]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0]:ends[-1]], ends - ends[0]


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
KEPT_POWERS = 1 << 21
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finalizer: spreads the bits of 64-bit keys."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_keys(fold_case: bool) -> np.ndarray:
    values = np.arange(256, dtype=np.uint64)
    if fold_case:
        values[65:91] += np.uint64(32)
    return mix(values + np.uint64(0x1234567))


def _power(base: int, upto: int, name: str) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < upto:
        size = max(1 << 16, 1 << (upto - 1).bit_length())
        grown = np.full(size, base, dtype=np.uint64)
        grown[0] = 1
        have = np.multiply.accumulate(grown)
        if size <= KEPT_POWERS:  # one very long text mustn't stay in a worker's memory
            _powers[name] = have
    return have[:upto]


def word_hashes(column: pa.Array, fold_case: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of a batch of texts, in order, and the offsets of each text's words among them.
    A word's hash depends on its bytes alone, so it is the same on every machine."""
    raw, ends = utf8_parts(column)
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
    inside = ~_SPACE[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = ends[(ends > 0) & (ends < n)]
    first[cut] = inside[cut]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[cut - 1] = inside[cut - 1]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_byte_keys(fold_case)[raw] * _power(_MULTIPLIER, n, "up"), out=sums[1:])
    hashes = (sums[stops] - sums[starts]) * _power(_INVERSE, n, "down")[starts]
    return mix(hashes + (stops - starts).astype(np.uint64)), np.searchsorted(starts, ends)
