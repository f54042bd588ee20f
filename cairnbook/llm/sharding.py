"""Sharding by extendible hashing, in DataFrame functions only.

A document's key has a path of hash bits. The directory holds a prefix for every shard: a bucket that is over the byte
limit splits on the next bit, and only such a bucket does, so a shard is the shortest prefix whose documents fit.

Scale: documents are read once for (path, bytes). Sums over cells, prefixes a few bits longer than a shard's, decide the
directory; cells are partially aggregated, and cells that are still too large are counted again over their own
documents only. No bucket is ever gathered, whatever its size.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnbook.llm.shared import fresh_path, materialise

BYTE_LIMIT = 1 << 20
#: Bits of a cell beyond those that shards of even size need.
FINER = 4
#: Bits of each of the two hashes of a path: the key's, then the row's own.
HASH_BITS = 60
PATH_BITS = 2 * HASH_BITS


def _directory(cells: DataFrame, shallow: int, deep: int, limit: int) -> DataFrame:
    """The shards among the prefixes of shallow to deep bits of the cells (cell, bytes, docs): the shortest that fit,
    or hold one document. shard is null where even the cell is too large."""
    depths = F.explode(F.sequence(F.lit(shallow), F.lit(deep))).alias("depth")
    nested = cells.select("bytes", "docs", "cell", depths).withColumn("shard", F.expr("substring(cell, 1, depth)"))
    sums = nested.groupBy("depth", "shard").agg(F.sum("bytes").alias("shard_bytes"), F.sum("docs").alias("shard_docs"))
    fits = sums.filter((F.col("shard_bytes") <= limit) | (F.col("shard_docs") == 1))
    # a prefix is a shard if it fits and the one that is a bit shorter doesn't
    shorter = fits.select((F.col("depth") + 1).alias("depth"), F.col("shard").alias("parent"))
    own = fits.withColumn("parent", F.expr("substring(shard, 1, greatest(depth - 1, 0))"))
    return own.join(shorter, ["depth", "parent"], "left_anti").select("depth", "shard", "shard_bytes", "shard_docs")


def extendible_shards(docs: DataFrame, key: str = "doc_id", byte_limit: int = BYTE_LIMIT) -> DataFrame:
    """docs: key, text. Returns key, bytes (UTF-8 length of the text), depth, shard (the prefix as a string of bits, the
    empty string for the only shard), shard_bytes, shard_docs.

    Every shard has byte_limit bytes at most, unless it holds a single document that is larger. Null text: 0 bytes.
    Null key: hashed as a value of its own. Rows that share a key are told apart by further bits from their texts and
    places. Empty table: no rows. Further columns of docs are ignored."""
    hash_of = lambda c: F.conv(F.substring(F.md5(c.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")
    bits = lambda c: F.lpad(F.bin(c), HASH_BITS, "0")
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    own = F.concat_ws("|", F.xxhash64("text").cast("string"), F.monotonically_increasing_id().cast("string"))
    sized = docs.select(F.col(key).alias("key"), size.alias("bytes"), hash_of(F.coalesce(F.col(key).cast("string"), F.lit("null"))).alias("h"), hash_of(own).alias("h2"))
    rows = materialise(sized, "shard-sizes")
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    pathed = rows.withColumn("path", F.concat(bits(F.col("h")), bits(F.col("h2"))))
    shallow, deep, out, open_rows = 0, min(PATH_BITS, max(0, math.ceil(math.log2(max(1, total / byte_limit)))) + FINER), None, pathed
    while True:
        cell = F.substring("path", 1, deep) if deep else F.lit("")
        celled = open_rows.withColumn("cell", cell)
        cells = materialise(celled.groupBy("cell").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("docs")), "shard-cells")
        directory = materialise(_directory(cells, shallow, deep, byte_limit), "shard-directory")
        # each cell looks its shard up: the directory's prefixes of it are one row at most
        deeper = F.explode(F.sequence(F.lit(shallow), F.lit(deep))).alias("depth")
        looked = cells.select("cell", deeper).withColumn("shard", F.expr("substring(cell, 1, depth)")).join(directory, ["depth", "shard"])
        placed = celled.join(looked, "cell").select("key", "bytes", "depth", "shard", "shard_bytes", "shard_docs")
        out = placed if out is None else out.unionByName(placed)
        rest = cells.join(looked.select("cell"), "cell", "left_anti")
        if deep == PATH_BITS or rest.isEmpty():
            break
        open_rows = materialise(celled.join(rest.select("cell"), "cell", "left_semi").drop("cell"), "shard-open")
        shallow, deep = deep + 1, min(PATH_BITS, deep + 2 * FINER)
    return out.withColumnRenamed("key", key)


def write_shards(docs: DataFrame, path: str | None = None, key: str = "doc_id", byte_limit: int = BYTE_LIMIT) -> str:
    """Writes docs as Parquet with a folder for each shard (shard=b<bits>) and returns the path. Keys must be unique."""
    spark: SparkSession = docs.sparkSession
    path = path or fresh_path(spark, "shards")
    where = extendible_shards(docs, key, byte_limit).select(key, F.concat(F.lit("b"), F.col("shard")).alias("shard"))
    docs.drop("shard").join(where, key).repartition("shard").sortWithinPartitions("shard").write.partitionBy("shard").parquet(path)
    return path


def op6_extendible_shards(spark, sf_dir: str) -> DataFrame:
    return extendible_shards(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "bytes", "depth", "shard", "shard_bytes", "shard_docs")


OP6_SQL = f"""
WITH d AS (
  SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS bytes,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, {HASH_BITS // 4}) AS BIGINT) AS h
  FROM documents
), p AS (
  SELECT doc_id, bytes, depth, h >> ({HASH_BITS} - depth) AS prefix FROM d, (SELECT unnest(range(0, 41)) AS depth)
), s AS (
  SELECT depth, prefix, sum(bytes) AS shard_bytes, count(*) AS shard_docs FROM p GROUP BY depth, prefix
), f AS (
  SELECT p.doc_id, p.bytes, p.depth, p.prefix, s.shard_bytes, s.shard_docs,
         row_number() OVER (PARTITION BY p.doc_id ORDER BY p.depth) AS k
  FROM p JOIN s ON p.depth = s.depth AND p.prefix = s.prefix
  WHERE s.shard_bytes <= {BYTE_LIMIT} OR s.shard_docs = 1
)
SELECT doc_id, bytes, CAST(depth AS INTEGER) AS depth, CASE WHEN depth = 0 THEN '' ELSE right(repeat('0', 60) || bin(prefix), CAST(depth AS INTEGER)) END AS shard,
       CAST(shard_bytes AS BIGINT) AS shard_bytes, CAST(shard_docs AS BIGINT) AS shard_docs
FROM f WHERE k = 1
"""
