"""The canonical upsert: created, versioned and unchanged items by natural key and hash, with versions, ids and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnbook.functions import text as tx
from cairnbook.functions.lineage import fixed

NATURAL_KEY = ["source_id", "account_id", "native_id"]


def _same(a: DataFrame, b: DataFrame, keys: list[str]):
    met = F.lit(True)
    for k in keys:
        met = met & a[k].eqNullSafe(b[k])
    return met


def ingest_outcomes(items: DataFrame, current: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """items: natural key, content_hash, seq (order in the batch). current: natural key, object_id, content_hash,
    version_num. Returns the items that change something or not, with outcome (created, versioned, unchanged) and
    version_num: repeats of one hash in a row count once, and a key that occurs again in the batch is versioned on.
    Null parts of a key match null."""
    keys = keys or NATURAL_KEY
    old = current.select(*[F.col(k).alias(f"_{k}") for k in keys], "object_id", F.col("content_hash").alias("old_hash"), "version_num")
    met = F.lit(True)
    for k in keys:
        met = met & F.col(k).eqNullSafe(F.col(f"_{k}"))
    joined = items.join(old, met, "left").drop(*[f"_{k}" for k in keys])
    order = Window.partitionBy(*keys).orderBy("seq")
    before = F.coalesce(F.lag("content_hash").over(order), F.col("old_hash"))
    first = F.col("object_id").isNull() & (F.row_number().over(order) == 1)
    outcome = F.when(first, "created").when(F.col("content_hash").eqNullSafe(before), "unchanged").otherwise("versioned")
    joined = joined.withColumn("outcome", outcome)
    steps = F.sum((F.col("outcome") != "unchanged").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return joined.withColumn("new_version", (F.coalesce("version_num", F.lit(0)) + steps).cast("int")).drop("old_hash", "version_num")


def allocate_ids(keys: DataFrame, order_by: str, high_water: int, parts: int = 64) -> DataFrame:
    """keys with object_id KB-%08d, dense from high_water + 1 in the order of a column. Ranges are numbered apart and
    offset by their counts, so no task sorts everything."""
    ranged = fixed(keys.repartitionByRange(parts, order_by).withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    base = counts.withColumn("_base", F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(order_by))
    return ranged.withColumn("_k", inside).join(base, "_part").withColumn("object_id", tx.object_id(F.col("_base") + F.col("_k") + high_water)).drop("_part", "_k", "_base")


def apply_outcomes(outcomes: DataFrame, current: DataFrame, high_water: int) -> tuple[DataFrame, DataFrame]:
    """(current, versions) after a batch: the head of every natural key, and the new object_version rows with their
    parents. Ids of created objects follow the natural key's order."""
    changed = outcomes.filter("outcome <> 'unchanged'")
    name = F.concat_ws("\x00", *[F.coalesce(F.col(k).cast("string"), F.lit("\x01")) for k in NATURAL_KEY])
    new = allocate_ids(outcomes.filter("outcome = 'created'").select(name.alias("_name")).distinct(), "_name", high_water).withColumnRenamed("object_id", "_new")
    named = changed.withColumn("_name", name).join(new, "_name", "left").withColumn("object_id", F.coalesce("object_id", "_new")).drop("_new", "_name")
    versions = named.select(
        tx.version_id(F.col("object_id"), F.col("new_version")).alias("version_id"), "object_id", F.col("new_version").alias("version_num"), "content_hash",
        F.when(F.col("new_version") > 1, tx.version_id(F.col("object_id"), F.col("new_version") - 1)).alias("parent_version_id"), "outcome",
    )
    heads = named.groupBy(*NATURAL_KEY).agg(F.max("object_id").alias("object_id"), F.max_by("content_hash", "new_version").alias("content_hash"), F.max("new_version").alias("version_num"))
    kept = current.join(heads.select("object_id"), "object_id", "left_anti")
    return kept.select(*NATURAL_KEY, "object_id", "content_hash", "version_num").unionByName(heads), versions


def current_objects(objects: DataFrame) -> DataFrame:
    return objects.filter("is_duplicate_of is null")


def resolve_edges(pending: DataFrame, natives: DataFrame) -> tuple[DataFrame, DataFrame]:
    """pending: source_native, target_native, type. natives: native_id, object_id. Returns (edges, unresolved count):
    an edge needs both ends, two different ones, and is written once."""
    src = natives.select(F.col("native_id").alias("source_native"), F.col("object_id").alias("source_object"))
    tgt = natives.select(F.col("native_id").alias("target_native"), F.col("object_id").alias("target_object"))
    met = pending.join(src, "source_native", "left").join(tgt, "target_native", "left")
    edges = met.filter("source_object is not null and target_object is not null and source_object <> target_object").select("source_object", "target_object", F.col("type").alias("relationship_type")).distinct()
    return edges, met.agg(F.count_if(F.col("source_object").isNull() | F.col("target_object").isNull()).alias("unresolved"))


def resolve_wikilinks(links: DataFrame, files: DataFrame) -> DataFrame:
    """links: source_path, target. files: path. A target with a slash is looked up by path, else by file name, else by
    stem. Returns source_path, target, status (OK, AMBIGUOUS, MISSING), path."""
    plain = F.regexp_replace("target", r"\.md$", "")
    named = files.select("path", F.regexp_replace("path", r"\.md$", "").alias("whole"), F.substring_index("path", "/", -1).alias("name"), tx.file_stem(F.col("path")).alias("stem"))
    hits = None
    for rank, (field, key) in enumerate((("whole", plain), ("name", F.col("target")), ("stem", plain))):
        side = named.select("path", F.col(field).alias("_k"))
        one = links.select("source_path", "target", key.alias("_k")).join(side, "_k").select("source_path", "target", F.lit(rank).alias("rank"), "path")
        if field == "whole":
            one = one.filter(F.contains("target", F.lit("/")))
        hits = one if hits is None else hits.unionByName(one)
    best = hits.distinct().groupBy("source_path", "target", "rank").agg(F.count("*").alias("n"), F.min("path").alias("path"))
    best = best.groupBy("source_path", "target").agg(F.min_by(F.struct("n", "path"), "rank").alias("b"))
    out = links.select("source_path", "target").distinct().join(best, ["source_path", "target"], "left")
    status = F.when(F.col("b").isNull(), "MISSING").when(F.col("b.n") > 1, "AMBIGUOUS").otherwise("OK")
    return out.select("source_path", "target", status.alias("status"), F.when(status == "OK", F.col("b.path")).alias("path"))


def record_visits(visits: DataFrame, old: DataFrame | None = None) -> DataFrame:
    """URL rows from visits (normalized_url, domain, ts, title) over older rows: count, first and last time, and the
    title of the earliest visit that has one."""
    new = visits.groupBy("normalized_url").agg(F.max("domain").alias("domain"), F.count("*").alias("visit_count"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.min_by("title", F.when(F.col("title").isNotNull(), F.struct("ts", "title"))).alias("title"))
    if old is None:
        return new
    both = old.select(*new.columns).withColumn("_age", F.lit(0)).unionByName(new.withColumn("_age", F.lit(1)))
    return both.groupBy("normalized_url").agg(F.max("domain").alias("domain"), F.sum("visit_count").alias("visit_count"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.min_by("title", F.when(F.col("title").isNotNull(), F.col("_age"))).alias("title"))


def workflow_wiring(workflows: DataFrame) -> DataFrame:
    """workflows: workflow_id, connections map<string, map<string, array<array<struct<node>>>>>. Returns FLOWS_TO rows:
    workflow_id, source_node, target_node."""
    one = workflows.select("workflow_id", F.explode("connections").alias("source_node", "kinds"))
    two = one.select("workflow_id", "source_node", F.explode("kinds").alias("kind", "outputs")).select("workflow_id", "source_node", F.explode(F.flatten("outputs")).alias("to"))
    return two.select("workflow_id", "source_node", F.col("to.node").alias("target_node")).distinct()


def register_dimensions(items: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Key values of the items that the dimension table doesn't have yet."""
    new = items.select(*keys).distinct()
    return new.join(known.select(*keys), _same(new, known, keys), "left_anti")
