"""Tabular exports whose files are declared, and the scans whose account must be stated."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnbook.functions.times import ts_iso
from cairnbook.sources.items import item

# The declared files of account exports, in the order in which a file's name is held against them: name,
# class, identity columns, title columns, date column, classification, memory type.
DECLARED = [
    ("connections", "Contact", ["URL", "First Name", "Last Name", "Company"], ["First Name", "Last Name"], "Connected On", "SENSITIVE", "REFERENCE"),
    ("positions", "Employment", ["Company Name", "Title", "Started On"], ["Title", "Company Name"], "Started On", "PRIVATE", "FACT"),
    ("education", "Education", ["School Name", "Start Date"], ["School Name", "Degree Name"], "Start Date", "PRIVATE", "FACT"),
    ("skills", "Skill", ["Name"], ["Name"], None, "PRIVATE", "FACT"),
    ("messages", "Message", ["CONVERSATION ID", "DATE", "FROM", "CONTENT"], ["SUBJECT", "FROM"], "DATE", "SENSITIVE", "OBSERVATION"),
    ("shares", "Post", ["Date", "ShareLink", "ShareCommentary"], ["ShareCommentary"], "Date", "PRIVATE", "OBSERVATION"),
    ("comments", "Comment", ["Date", "Link", "Message"], ["Message"], "Date", "PRIVATE", "OBSERVATION"),
    ("reactions", "Reaction", ["Date", "Link", "Type"], ["Type", "Link"], "Date", "PRIVATE", "OBSERVATION"),
    ("invitations", "Invitation", ["From", "To", "Sent At"], ["From", "To"], "Sent At", "SENSITIVE", "OBSERVATION"),
    ("company follows", "SocialLink", ["Organization"], ["Organization"], "Followed On", "PRIVATE", "REFERENCE"),
    ("recommendations", "Recommendation", ["First Name", "Last Name", "Creation Date"], ["First Name", "Last Name"], "Creation Date", "PRIVATE", "OBSERVATION"),
    ("saved_items", "Bookmark", ["savedItem"], ["savedItem"], None, "PRIVATE", "REFERENCE"),
    ("profile", "ProfileFact", ["First Name", "Last Name", "Headline"], ["Headline"], None, "PRIVATE", "FACT"),
    ("learning", "Course", ["Content Title", "Content Completed At"], ["Content Title"], "Content Completed At", "PRIVATE", "REFERENCE"),
    ("sales", "Sale", ["Order Number", "Purchase Date", "Buyer Email", "Item Name"], ["Item Name", "Buyer Name"], "Purchase Date", "SENSITIVE", "FACT"),
    ("products", "Product", ["Name", "Permalink"], ["Name"], "Published At", "PRIVATE", "FACT"),
    ("customers", "Contact", ["Email", "Name"], ["Name", "Email"], "Created At", "SENSITIVE", "REFERENCE"),
    ("subscribers", "Contact", ["Email"], ["Email"], "Created At", "SENSITIVE", "REFERENCE"),
]
# Columns that hold addresses, and dates to fall back on.
URL_COLUMNS = ["URL", "Link", "ShareLink", "SharedUrl", "Permalink", "SENDER PROFILE URL", "Profile Url", "savedItem"]
DATE_FALLBACKS = ["Date", "date", "Created At", "Purchase Date", "Sent At", "Connected On", "Started On"]
_SPEC = "k int, name string, object_class string, ids array<string>, titles array<string>, date_column string, classification string, memory_type string"
# The scans whose exports bear no sign of the account that made them.
NEEDS_IDENTITY = ["takeout", "mbox", "notion", "github-stars", "chatgpt", "airtable", "instagram", "facebook", "linkedin", "gumroad", "obsidian", "n8n"]


def require_identity(scan: str, identity: str | None) -> str:
    """The account that an export is said to be of; raises, before any job starts, where one must be stated and isn't."""
    if scan in NEEDS_IDENTITY and not (identity or "").strip():
        raise ValueError(f"the scan {scan} needs the account that its export belongs to")
    return (identity or "").strip()


def declared_files(spark: SparkSession) -> DataFrame:
    """DECLARED as a table of a few rows."""
    return spark.createDataFrame([(k, n.replace(" ", "_"), *rest) for k, (n, *rest) in enumerate(DECLARED)], _SPEC)


def scan_declared(rows: DataFrame, product: str, identity: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """rows: path, row (map of column to cell) of CSV files. Returns (items, URL visits, files: path, recognised). The
    first declared name that a file's name holds gives its class and keys; cells of key columns that are empty don't
    count, and rows of other files, or without any key, are keyed by all their cells, in the order of their names. So the
    order of rows and columns never matters."""
    require_identity(product, identity)
    stem = F.regexp_replace(F.lower(F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "")), "[- ]", "_")
    files = rows.select("path").distinct().withColumn("_stem", stem)
    spec = declared_files(rows.sparkSession)
    met = files.join(F.broadcast(spec), F.contains("_stem", F.col("name")), "left")  # 18 rows
    best = met.groupBy("path", "_stem").agg(F.min_by(F.struct(*[F.col(c) for c in spec.columns]), "k").alias("s"))
    clean = F.map_filter(F.transform_values("row", lambda _, v: F.trim(F.coalesce(v, F.lit("")))), lambda _, v: v != "")
    r = rows.join(best, "path").select("path", "_stem", "s", clean.alias("row")).filter(F.size("row") > 0)
    pair = lambda c: F.concat(c, F.lit("="), F.col("row")[c])
    told = F.array_join(F.transform(F.filter("s.ids", lambda c: F.map_contains_key("row", c)), pair), "|")
    whole = F.array_join(F.transform(F.array_sort(F.map_keys("row")), pair), "|")
    key = F.coalesce(F.nullif(told, F.lit("")), whole)
    title = F.trim(F.array_join(F.transform("s.titles", lambda c: F.coalesce(F.try_element_at("row", c), F.lit(""))), " "))
    title = F.coalesce(F.nullif(title, F.lit("")), F.when(F.col("s").isNull() | F.col("s.name").isNull(), F.try_element_at(F.map_values("row"), F.lit(1))), F.col("_stem"))
    dated = F.coalesce(ts_iso(F.try_element_at("row", F.col("s.date_column"))), *[ts_iso(F.try_element_at("row", F.lit(c))) for c in DATE_FALLBACKS])
    r = r.withColumns({"_when": dated, "_title": F.substring(title, 1, 500)})
    body = F.array_join(F.transform(F.map_entries("row"), lambda e: F.concat_ws(": ", e["key"], e["value"])), "\n")
    native = F.concat_ws(":", F.lit(product), "_stem", F.substring(F.sha2(key, 256), 1, 24))
    facts = F.to_json(F.struct(F.coalesce("s.classification", F.lit("PRIVATE")).alias("classification"), F.coalesce("s.memory_type", F.lit("REFERENCE")).alias("memory_type"), F.when(told != "", "declared key columns").otherwise("whole row").alias("identity_basis")))
    items = r.select(*item(product, F.lit(identity), native, F.coalesce("s.object_class", F.lit("TabularRecord")), F.col("_title"), body, path=F.col("path"), created=F.col("_when"), modified=F.col("_when"), metadata=facts))
    urls = r.select(F.explode(F.transform(F.array(*map(F.lit, URL_COLUMNS)), lambda c: F.try_element_at("row", c))).alias("url"), F.col("_when").alias("ts"), F.col("_title").alias("title"), F.lit("referenced").alias("kind")).filter(F.lower("url").startswith("http"))
    return items, urls, best.select("path", F.col("s.name").isNotNull().alias("recognised"))
