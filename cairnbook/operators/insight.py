"""Reports of the store on itself: gaps, dark months, shares, reading against writing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnbook.functions.times import month


def gap(frame: DataFrame, name: str, severity: str) -> DataFrame:
    """One row (gap, n, severity) that counts the frame."""
    return frame.agg(F.count("*").alias("n")).select(F.lit(name).alias("gap"), "n", F.lit(severity).alias("severity"))


def gaps(parts: list[DataFrame]) -> DataFrame:
    """Gaps that count something, worst first."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    order = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    return out.filter("n > 0").orderBy(order, F.desc("n"), "gap")


def months_dark(rows: DataFrame, ts: str) -> DataFrame:
    """Months inside the observed span without a row. Null times count for nothing; an empty table has none."""
    seen = rows.filter(F.col(ts).isNotNull()).select(month(F.col(ts)).alias("month")).distinct()
    span = rows.agg(F.min(ts).alias("a"), F.max(ts).alias("b")).filter("a is not null")
    every = span.select(F.explode(F.sequence(F.trunc("a", "month"), F.trunc("b", "month"), F.expr("interval 1 month"))).alias("m")).select(F.date_format("m", "yyyy-MM").alias("month"))
    return every.join(seen, "month", "left_anti")


def shares(rows: DataFrame, column: str) -> DataFrame:
    """n and percent of each value of a column; the total is that of the same rows."""
    per = rows.groupBy(column).agg(F.count("*").alias("n"))
    return per.select(F.lit(column).alias("section"), F.col(column).cast("string").alias("key"), "n", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 2).alias("percent"))


def read_vs_write(objects: DataFrame, surfaced: DataFrame) -> DataFrame:
    """surfaced: object_id per answered query. How much of the store any query ever surfaced."""
    n = surfaced.agg(F.countDistinct("object_id").alias("surfaced"))
    return objects.agg(F.count("*").alias("stored")).join(F.broadcast(n)).select("stored", "surfaced", F.round(100.0 * F.col("surfaced") / F.greatest(F.col("stored"), F.lit(1)), 2).alias("percent"))


def history(visits: DataFrame) -> DataFrame:
    """Visits, URLs and domains in all, and the span."""
    return visits.agg(F.count("*").alias("n_visits"), F.countDistinct("normalized_url").alias("n_urls"), F.countDistinct("domain").alias("n_domains"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


def top_domains(visits: DataFrame, limit: int = 25) -> DataFrame:
    return visits.groupBy("domain").agg(F.count("*").alias("n_visits"), F.countDistinct("normalized_url").alias("n_urls")).orderBy(F.desc("n_visits"), "domain").limit(limit)


def server_matrix(audits: DataFrame, expected: list[str]) -> DataFrame:
    """audits: host, sections (map of name to lines). Missing sections of each host."""
    return audits.select("host", F.array_sort(F.array_except(F.array(*map(F.lit, expected)), F.map_keys("sections"))).alias("missing"))


#: Signals that the ranking declares and doesn't have.
UNIMPLEMENTED_SIGNALS = ["personal_relevance", "historical_importance"]
# Fixed value: classes that have no body by design.
BODILESS = ["FileReference"]


def all_gaps(objects: DataFrame, urls: DataFrame, dead_letters: DataFrame, conflicts: DataFrame, declared: DataFrame, present: DataFrame, acquired: DataFrame) -> DataFrame:
    """The ten gaps of a store: gap, n, severity. objects: object_class, knowledge_state, body, classification. urls:
    fetch_status. conflicts: status. declared, present: source_id. acquired: ts."""
    signals = objects.sparkSession.createDataFrame([(x,) for x in UNIMPLEMENTED_SIGNALS], "signal string")
    never = declared.select("source_id").distinct().join(present.select("source_id"), "source_id", "left_anti")
    empty = F.coalesce("body", F.lit("")) == ""
    found = [
        (urls.filter("fetch_status = 'NOT_FETCHED'"), "urls_never_fetched", "high"), (objects.filter(F.col("object_class").isin(BODILESS)), "files_named_but_never_acquired", "high"),
        (objects.filter(empty & ~F.col("object_class").isin(BODILESS)), "objects_with_no_body_unexpected", "medium"), (objects.filter("classification = 'RESTRICTED'"), "content_withheld_for_credentials", "info"),
        (dead_letters, "items_in_dead_letter", "medium"), (objects.filter("object_class = 'Answer' and knowledge_state = 'SYNTHESIZED'"), "answers_awaiting_human_review", "medium"),
        (conflicts.filter("status = 'OPEN'"), "open_conflicts", "high"), (never, "sources_never_ingested", "high"), (signals, "ranking_signals_unimplemented", "info"), (months_dark(acquired, "ts"), "months_with_nothing_captured", "medium"),
    ]
    return gaps([gap(*x) for x in found])


def top_tags(rows: DataFrame, limit: int = 25) -> DataFrame:
    """rows: tags (array). The most frequent ones, ties by name."""
    return rows.select(F.explode("tags").alias("tag")).filter("tag <> ''").groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(limit)


def meta(objects: DataFrame, chain: DataFrame) -> DataFrame:
    """section, key, n, percent (of its section): the store by state, authority, class and decay, whose voice it is, the
    health of provenance over the same objects, and captures by month and year. objects: object_id, knowledge_state,
    authority, object_class, decay_status, created_at. chain: object_id, complete. One row per value reaches the totals,
    not one per object."""
    o = objects.join(chain.select("object_id", F.col("complete").alias("_ok")), "object_id", "left")
    voice = F.when(F.col("authority") == "PRIMARY SOURCE", "own words").when(F.col("authority") == "AI-GENERATED", "assistant").otherwise("other")
    health = F.when(F.col("_ok"), "complete").otherwise("broken")
    sections = {"state": F.col("knowledge_state"), "authority": F.col("authority"), "class": F.col("object_class"), "decay": F.col("decay_status"), "voice": voice, "provenance": health, "month": month(F.col("created_at")), "year": F.date_format("created_at", "yyyy")}
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("section"), c.alias("key")) for k, c in sections.items()]))
    per = o.select(pairs.alias("p")).select("p.*").filter("key is not null").groupBy("section", "key").agg(F.count("*").alias("n"))
    return per.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("section")), 2))


def compare_servers(runs: DataFrame) -> DataFrame:
    """runs: host, run, containers, volumes, mounted (arrays of names). For each run of a host against the one before: what
    came, what went, and the volumes that nothing mounts."""
    before = Window.partitionBy("host").orderBy("run")
    none = F.array().cast("array<string>")
    was = F.lag("containers").over(before)
    now = F.coalesce("containers", none)
    sort = lambda a: F.array_sort(a)
    return runs.select("host", "run", F.when(was.isNotNull(), sort(F.array_except(now, was))).alias("came"), F.when(was.isNotNull(), sort(F.array_except(was, now))).alias("went"), sort(F.array_except(F.coalesce("volumes", none), F.coalesce("mounted", none))).alias("orphan_volumes"))
