"""The derived knowledge graph: entities by rule, edges to them, mentions in texts, merges and retirement."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnbook.functions import text as tx
from cairnbook.functions.lineage import spread, stored
from cairnbook.functions.urls import registrable_domain

SATURATION, TOP_MENTIONS, MIN_TITLE = 0.05, 500, 4
DESCEND_ABOVE, MAX_LEVELS = 0.95, 3
# BM25's usual constants.
K1, B = 1.2, 0.75
# Endings of a path segment that make it a file, not a folder.
FILE_ENDINGS = [".zip", ".tar", ".gz", ".rar", ".7z", ".png", ".jpg", ".jpeg", ".pdf", ".json", ".csv", ".txt", ".md", ".html", ".docx", ".xlsx"]
CONTAINERS = ["Conversation", "Project", "AssistantMemory", "Source"]


def domain_entities(urls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities: title, n_urls; edges: normalized_url, title, HOSTED_AT) by registrable domain."""
    d = urls.filter("normalized_url is not null").select("normalized_url", registrable_domain(F.col("domain")).alias("title")).distinct()
    return d.groupBy("title").agg(F.count("*").alias("n_urls")), d.withColumn("relationship_type", F.lit("HOSTED_AT"))


def group_entities(objects: DataFrame, column: str, relation: str) -> DataFrame:
    """Edges of distinct objects to the entity that a column names (workspace, account)."""
    return objects.filter(F.col(column).isNotNull()).select("object_id", F.col(column).alias("title"), F.lit(relation).alias("relationship_type")).distinct()


def folder_entities(objects: DataFrame) -> DataFrame:
    """STORED_IN edges: object_id, title. The folder is the first path segment below the deepest directory that all
    paths share, one level deeper (at most MAX_LEVELS times) while one segment holds nearly all. Depths are decided by
    small aggregates; hidden names and names of files are dropped."""
    parts = F.filter(F.split("native_path", "/"), lambda x: x != "")
    dirs = objects.filter("native_path is not null").select("object_id", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))).alias("dirs"))
    # the longest common prefix of the least and the greatest path is that of all
    ends = dirs.agg(F.min("dirs").alias("a"), F.max("dirs").alias("b")).first()
    depth = 0
    if ends["a"] is not None:
        while depth < min(len(ends["a"]), len(ends["b"])) and ends["a"][depth] == ends["b"][depth]:
            depth += 1
    for _ in range(MAX_LEVELS):
        top = dirs.filter(F.size("dirs") > depth).groupBy(F.col("dirs")[depth].alias("s")).count().agg(F.max("count").alias("m"), F.sum("count").alias("t"), F.count("*").alias("k")).first()
        if not top["k"] or not (top["k"] == 1 or top["m"] / top["t"] > DESCEND_ABOVE):
            break
        depth += 1
    title = F.try_element_at("dirs", F.lit(depth + 1))
    good = title.isNotNull() & ~title.startswith(".")
    for ending in FILE_ENDINGS:
        good = good & ~F.lower(title).endswith(ending)
    return dirs.filter(good).select("object_id", title.alias("title"), F.lit("STORED_IN").alias("relationship_type"))


def mentions(objects: DataFrame, titles: DataFrame, saturation: float = SATURATION, top: int = TOP_MENTIONS, min_len: int = MIN_TITLE) -> DataFrame:
    """objects: object_id, body. titles: title (phrases). Returns title, object_id, score, rank of the `top` best texts
    per title by BM25 of the phrase, and saturated titles with a null object_id: those in more than a share of all
    objects earn no edges. Null bodies and titles have no words; repeated titles count once.

    Texts become narrow rows of word runs, one per position and distinct phrase length (a handful: only these lengths
    reach the driver). Texts are dealt over all cores and read once: runs meet the phrases, are counted per object where
    they are and stored, with a row for each text from which the totals come."""
    phrases = titles.filter(F.length("title") >= min_len).select("title", tx.tokens(F.col("title")).alias("words")).filter(F.size("words") > 0).distinct()
    phrases = stored(phrases.select("title", F.size("words").alias("k"), F.array_join("words", " ").alias("run")))
    lengths = sorted(r["k"] for r in phrases.select("k").distinct().collect())
    docs = spread(objects.select("object_id", "body"), "object_id").select("object_id", tx.tokens(F.col("body")).alias("words"))
    ahead = lambda i, k: F.concat_ws(" ", *[F.get("words", i + j) for j in range(k)])
    runs = lambda k: F.transform(F.slice(F.sequence(F.lit(0), F.size("words")), F.lit(1), F.greatest(F.size("words") - k + 1, F.lit(0))), lambda i: ahead(i, k)) if k > 1 else F.col("words")
    every = F.flatten(F.array(*[runs(k) for k in lengths], F.array(F.lit(""))))  # the empty run stands for the text itself
    wanted = phrases.select("run").union(phrases.sparkSession.createDataFrame([("",)], "run string")).distinct()
    found = docs.select("object_id", F.size("words").alias("len"), F.explode(every).alias("run")).join(wanted, "run", "left_semi")
    found = stored(found.groupBy("object_id", "len", "run").agg(F.count("*").alias("tf")))
    whole = found.filter("run = ''").agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("total"), (F.sum(F.col("tf") * F.col("len")) / F.sum("tf")).alias("mean"))
    found = found.filter("run <> ''").join(phrases.select("title", "run"), "run")
    per = found.groupBy("title").agg(F.count("*").alias("n")).join(F.broadcast(whole))  # one row
    per = per.withColumn("saturated", F.col("n") > F.greatest(F.floor(F.col("total") * saturation), F.lit(1)))
    idf = F.greatest(F.log((F.col("total") - F.col("n") + 0.5) / (F.col("n") + 0.5)), F.lit(1e-6))
    score = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    kept = found.join(per.filter("not saturated"), "title").withColumn("score", F.round(score, 6))
    rank = F.row_number().over(Window.partitionBy("title").orderBy(F.desc("score"), "object_id"))
    best = kept.withColumn("rank", rank).filter(F.col("rank") <= top).select("title", "object_id", "score", "rank")
    full = per.filter("saturated").select("title", F.lit(None).cast("string").alias("object_id"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("int").alias("rank"))
    return best.unionByName(full)


def account_entities(objects: DataFrame) -> DataFrame:
    """BELONGS_TO edges of containers (conversations, projects, ...) to their account; other objects get none."""
    return group_entities(objects.filter(F.col("object_class").isin(CONTAINERS)), "account_id", "BELONGS_TO")


def rebuild_edges(edges: DataFrame, derived: DataFrame) -> DataFrame:
    """Edges after a rebuild: those that a rule made go, the newly derived ones come. Twice is once."""
    kept = edges.filter(~F.coalesce(F.col("created_by").startswith("rule:"), F.lit(False)))
    return kept.unionByName(derived).dropDuplicates(["source_object", "target_object", "relationship_type"])


def retire_orphans(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """entities: object_id, decay_status, is_duplicate_of. Their new status: SUPERSEDED without an inbound edge, CURRENT
    again with one. Aliases stay as they are."""
    targets = edges.select(F.col("target_object").alias("object_id")).distinct().withColumn("_hit", F.lit(True))
    joined = entities.join(targets, "object_id", "left")
    status = F.when(F.col("is_duplicate_of").isNotNull(), F.col("decay_status")).when(F.col("_hit"), "CURRENT").otherwise("SUPERSEDED")
    return joined.select("object_id", status.alias("decay_status"))


def graph_stats(edges: DataFrame) -> DataFrame:
    return edges.groupBy("relationship_type").agg(F.count("*").alias("n"), F.countDistinct("source_object").alias("sources"), F.countDistinct("target_object").alias("targets"))


def neighbours(edges: DataFrame, ids: DataFrame, limit: int | None = None) -> DataFrame:
    """ids: object_id. Their neighbours in both directions; limit, if any, is per object."""
    out = edges.select(F.col("source_object").alias("object_id"), F.col("target_object").alias("neighbour"), "relationship_type", F.lit("out").alias("direction"))
    into = edges.select(F.col("target_object").alias("object_id"), F.col("source_object").alias("neighbour"), "relationship_type", F.lit("in").alias("direction"))
    met = out.unionByName(into).join(ids.select("object_id"), "object_id", "left_semi")
    if limit is None:
        return met
    order = Window.partitionBy("object_id").orderBy("direction", "relationship_type", "neighbour")
    return met.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= limit).drop("_r")


def second_degree(edges: DataFrame, keep: int = 20, limit: int | None = None) -> DataFrame:
    """object_id, second, paths: objects two steps away, in either direction, and by how many ways; neither the object
    itself nor its neighbours. A step goes to the `keep` neighbours of an object with the fewest neighbours of their own
    (ties by id): what few share tells more than what all do. So a hub, whatever its degree, is entered by those that it
    is among the best of, and is left to `keep` others: rows grow with the objects, not with the square of a hub.
    limit: the most paths per object, ties by id."""
    one = edges.filter("source_object <> target_object").select(F.col("source_object").alias("a"), F.col("target_object").alias("b"))
    both = one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    degree = both.groupBy(F.col("a").alias("b")).agg(F.count("*").alias("degree"))
    order = Window.partitionBy("a").orderBy("degree", "b")
    best = both.join(degree, "b").withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= keep).select("a", "b")
    two = best.join(best.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").filter("a <> c")
    found = two.groupBy("a", "c").agg(F.count("*").alias("paths")).join(both.select("a", F.col("b").alias("c")), ["a", "c"], "left_anti")
    found = found.select(F.col("a").alias("object_id"), F.col("c").alias("second"), "paths")
    if limit is None:
        return found
    rank = F.row_number().over(Window.partitionBy("object_id").orderBy(F.desc("paths"), "second"))
    return found.withColumn("_r", rank).filter(F.col("_r") <= limit).drop("_r")


def by_in_degree(edges: DataFrame, limit: int) -> DataFrame:
    """The entities with most inbound edges, ties by id."""
    return edges.groupBy(F.col("target_object").alias("object_id")).agg(F.count("*").alias("in_degree")).orderBy(F.desc("in_degree"), "object_id").limit(limit)


def find_entities(entities: DataFrame, edges: DataFrame, term: str, limit: int = 15) -> DataFrame:
    """Entities (object_id, title) whose title contains the term, whatever its case, by in-degree."""
    degree = edges.groupBy(F.col("target_object").alias("object_id")).agg(F.count("*").alias("in_degree"))
    met = entities.filter(F.col("title").ilike(f"%{term}%")).join(degree, "object_id", "left")
    return met.select("object_id", "title", F.coalesce("in_degree", F.lit(0)).alias("in_degree")).orderBy(F.desc("in_degree"), "object_id").limit(limit)


def merge_entities(edges: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """decisions: canonical, alias, confirmed_by. Returns (edges with targets moved from aliases to their canonical
    ones, accepted decisions). A decision needs a named decider; one that is applied again changes nothing."""
    good = decisions.filter("confirmed_by is not null and trim(confirmed_by) <> '' and canonical <> alias").groupBy("alias").agg(F.min_by("canonical", tx.id_order(F.col("canonical"))).alias("canonical"), F.min("confirmed_by").alias("confirmed_by"))
    moved = edges.join(good.select(F.col("alias").alias("target_object"), "canonical"), "target_object", "left").withColumn("target_object", F.coalesce("canonical", "target_object")).drop("canonical")
    return moved.filter("source_object <> target_object").dropDuplicates(["source_object", "target_object", "relationship_type"]), good
