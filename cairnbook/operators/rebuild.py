"""The derived graph as one rebuild: entities by rule under ids that last, edges of the rules of today only, mentions,
retirement, and provenance of every version. A rebuild over the same inputs changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnbook.functions import text as tx
from cairnbook.functions.lineage import fixed
from cairnbook.functions.urls import registrable_domain
from cairnbook.operators import graph
from cairnbook.operators.canonical import allocate_ids

ENTITIES = "object_id string, entity_class string, title string, rule string, decay_status string, saturated boolean, version_num int"
EDGES = "source_object string, target_object string, relationship_type string, created_by string"
PROVENANCE = "version_id string, object_id string, transformation_id string"
#: Classes whose titles are looked for in texts.
MENTIONED = ["Domain", "Server", "Workspace"]


def derive(objects: DataFrame, urls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities: entity_class, title, rule; edges: source_object, entity_class, title, relationship_type, rule) by the
    rules on structure. objects: object_id, object_class, source_id, account_id, native_path. urls: object_id,
    normalized_url, domain."""
    tag = lambda rows, cls, rule: rows.select(F.col("object_id").alias("source_object"), F.lit(cls).alias("entity_class"), "title", "relationship_type", F.lit(rule).alias("rule"))
    hosted = urls.filter("normalized_url is not null").select("object_id", registrable_domain(F.col("domain")).alias("title"), F.lit("HOSTED_AT").alias("relationship_type")).filter("title is not null")
    edges = tag(hosted, "Domain", "domain-from-url").distinct()
    edges = edges.unionByName(tag(graph.group_entities(objects, "source_id", "BELONGS_TO"), "Workspace", "workspace-from-registry"))
    edges = edges.unionByName(tag(graph.account_entities(objects), "Account", "account-from-registry"))
    edges = edges.unionByName(tag(graph.folder_entities(objects), "Folder", "folder-from-path"))
    accounts = objects.filter("account_id is not null").select(F.lit("Account").alias("entity_class"), F.col("account_id").alias("title"), F.lit("account-from-registry").alias("rule"))
    return edges.select("entity_class", "title", "rule").unionByName(accounts).filter("trim(title) <> ''").groupBy("entity_class", "title").agg(F.min("rule").alias("rule")), edges


def rebuild(objects: DataFrame, urls: DataFrame, entities: DataFrame, edges: DataFrame, high_water: int) -> dict[str, DataFrame]:
    """objects also carry body; entities and edges are what the last rebuild left (ENTITIES, EDGES). Returns entities,
    edges and provenance (of the versions that this rebuild made).

    Known entities (by class and title) keep their ids, new ones get the next. Edges of rules are replaced, acquired ones
    stay. An entity without an inbound edge is superseded, with one it is current again; each change of state, and a title
    that is too frequent to be mentioned, is a new version."""
    wanted, structural = derive(objects, urls)
    wanted, structural = fixed(wanted), fixed(structural)
    old = entities.select(*[c.split(" ")[0] for c in ENTITIES.split(", ")])
    fresh = wanted.join(old.select("entity_class", "title"), ["entity_class", "title"], "left_anti").withColumn("_name", F.concat_ws("\x00", "entity_class", "title"))
    new = allocate_ids(fresh, "_name", high_water).withColumns({"decay_status": F.lit("CURRENT"), "saturated": F.lit(False), "version_num": F.lit(1), "_new": F.lit(True)}).drop("_name")
    known = fixed(old.withColumn("_new", F.lit(False)).unionByName(new))
    names = known.select("object_id", "entity_class", "title")
    made = structural.join(names, ["entity_class", "title"]).select("source_object", F.col("object_id").alias("target_object"), "relationship_type", F.concat(F.lit("rule:"), "rule").alias("created_by"))
    sought = names.filter(F.col("entity_class").isin(MENTIONED))
    found = fixed(graph.mentions(objects.select("object_id", "body"), sought.select("title")))
    named = found.filter("object_id is not null").select(F.col("object_id").alias("source_object"), "title").join(sought.select(F.col("object_id").alias("target_object"), "title"), "title")
    made = made.unionByName(named.select("source_object", "target_object", F.lit("MENTIONS").alias("relationship_type"), F.lit("rule:mention-fts").alias("created_by")))
    after = fixed(graph.rebuild_edges(edges, made.filter("source_object <> target_object")))
    status = graph.retire_orphans(known.withColumn("is_duplicate_of", F.lit(None).cast("string")), after).withColumnRenamed("decay_status", "_status")
    frequent = found.filter("object_id is null").select("title", F.lit(True).alias("_full")).distinct()
    full = sought.join(frequent, "title").select("object_id", "_full")
    met = known.join(status, "object_id").join(full, "object_id", "left").withColumn("_full", F.coalesce("_full", F.lit(False)))
    # versions: the entity itself, saturation, retirement or revival
    steps = F.array_compact(F.array(
        F.when(F.col("_new"), F.concat(F.lit("graph:"), "rule")), F.when(F.col("_full") & ~F.col("saturated"), F.lit("graph:mention-saturation")),
        F.when(F.col("_status") != F.col("decay_status"), F.when(F.col("_status") == "SUPERSEDED", F.lit("graph:retire-orphan")).otherwise(F.lit("graph:revive"))),
    ))
    met = fixed(met.withColumn("_steps", steps).withColumn("_base", F.when(F.col("_new"), 0).otherwise(F.col("version_num"))))
    versions = met.select("object_id", "_base", F.posexplode("_steps").alias("k", "transformation_id"))
    return {
        "entities": met.select("object_id", "entity_class", "title", "rule", F.col("_status").alias("decay_status"), F.col("_full").alias("saturated"), (F.col("_base") + F.size("_steps")).cast("int").alias("version_num")),
        "edges": after,
        "provenance": versions.select(tx.version_id(F.col("object_id"), F.col("_base") + F.col("k") + 1).alias("version_id"), "object_id", "transformation_id"),
    }


def empty_graph(spark) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame([], ENTITIES), spark.createDataFrame([], EDGES)
