"""The corpus pipeline: quality rules, near-dedup, PII redaction, source mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. The
stages' own state lies in the folder that the cluster shares, so a lost executor costs a new read.

For all stages: docs has the columns of documents; others are dropped, whatever their names. Null keys, repeated keys and
equal rows are rows of their own; a null or empty text is an empty one; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnbook.llm import byte_bpe, mixing, near_dedup, pii, quality
from cairnbook.llm.shared import delete, materialise, salted_left_join, scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _keyed(docs: DataFrame) -> tuple[DataFrame, bool]:
    """docs with _row, a key that only equal rows share, and whether there can be equal rows: the doc_id, or where it is
    null or not the row's alone, a hash of the row, above all doc_ids below 2 ** 62."""
    shared = docs.groupBy("doc_id").agg(F.count("*").alias("_n")).filter("doc_id is null or _n > 1").select("doc_id", F.lit(True).alias("_shared"))
    if shared.isEmpty():
        return docs.withColumn("_row", F.col("doc_id").cast("long")), False
    hashed = F.xxhash64(*COLUMNS).bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    marked = salted_left_join(docs, shared, ["doc_id"])
    return marked.withColumn("_row", F.when(F.col("_shared"), hashed).otherwise(F.col("doc_id").cast("long"))).drop("_shared"), True


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows that the rules reject, each judged by its own text. Rows without a text go, as too short."""
    docs, _ = _keyed(docs)
    bad = quality.quality_rules(docs, "_row").filter(~F.col("kept")).select("_row").distinct()
    return docs.join(bad, "_row", "left_anti").select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: its least doc_id; rows whose doc_id is null or shared come
    after all others."""
    docs, _ = _keyed(docs)
    copies = near_dedup.near_duplicates(docs, "_row").filter(~F.col("kept")).select("_row").distinct()
    return docs.join(copies, "_row", "left_anti").dropDuplicates(["_row"]).select(*COLUMNS)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind in brackets; n_chars follows. A null text stays null, with a null n_chars."""
    clean = pii.redact(pii.find(docs, pii.fit(docs)))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice. Texts without a word are never taken."""
    docs, equal = _keyed(docs)
    taken = mixing.mix_sources(docs, "_row").select("_row", "repeats").filter("repeats > 0")
    if equal:
        docs, taken = docs.dropDuplicates(["_row"]), taken.groupBy("_row").agg(F.sum("repeats").cast("int").alias("repeats"))
    return docs.join(taken, "_row").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("repeats")))).select(*COLUMNS)


def byte_bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the bytes that they decode to; of a null text those of nothing."""
    return byte_bpe.digests(byte_bpe.encode(docs.select("doc_id", "text"), with_decoded=True))


STAGES = [
    ("quality_rules", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("byte_bpe", byte_bpe_stage),
]

#: The fitted distances, MinHash and the boosted trees have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each over a written table of what its predecessor kept. When a stage's table is
    written, the tables that it came from are deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch(spark) as kept:
        for name, stage in STAGES[:-1]:
            with scratch(spark) as made:
                docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
                written = made.pop()
            while kept:
                delete(spark, kept.pop())
            kept.append(written)
        kept.clear()  # the last stage reads it when the result is asked for
    return STAGES[-1][1](spark, docs, sf_dir)
