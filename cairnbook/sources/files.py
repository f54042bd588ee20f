"""Files: listing, kinds, exclusions, hashes; and notes of a vault."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnbook.functions import text as tx
from cairnbook.sources.items import item

# Kinds by extension, and what is code or build output.
KINDS = {
    "pdf": [".pdf"], "doc": [".doc", ".docx", ".odt", ".rtf"], "text": [".txt", ".md", ".markdown", ".org", ".tex"], "sheet": [".xls", ".xlsx", ".xlsm", ".ods", ".csv", ".tsv"],
    "slides": [".ppt", ".pptx", ".odp", ".key"], "ebook": [".epub", ".mobi", ".azw3"], "image": [".png", ".jpg", ".jpeg", ".gif", ".webp", ".svg", ".bmp", ".tiff", ".heic"],
    "web": [".html", ".htm", ".mhtml", ".har"], "data": [".json", ".jsonl", ".xml", ".yaml", ".yml"], "contact": [".vcf"], "calendar": [".ics"],
    "media": [".mp3", ".wav", ".m4a", ".mp4", ".mov"], "archive": [".zip", ".tar", ".gz", ".7z"],
}
EXCLUDED_EXTENSIONS = """.py .js .jsx .ts .tsx .java .c .h .cpp .hpp .cs .go .rs .rb .php .swift .kt .scala .sh .bash .zsh .ps1 .bat .lock .map .pyc .pyo .class .o .so .dll
.dylib .a .obj .exe .msi .deb .rpm .appimage .dmg .pkg .jar .war""".split()
EXCLUDED_FOLDERS = """node_modules .git .svn __pycache__ .next .nuxt dist build target vendor .venv venv env .tox .gradle .idea .vscode .pytest_cache .mypy_cache site-packages
.cache bower_components .terraform coverage .nyc_output .parcel-cache .turbo""".split()
INLINE_KINDS, INLINE_BYTES = ["text", "web", "data"], 512 << 10


def kind_of(path: Column) -> Column:
    suffix, out = tx.file_suffix(path), F.lit(None).cast("string")
    for kind, endings in KINDS.items():
        out = F.when(suffix.isin(endings), kind).otherwise(out)
    return out


def list_files(spark: SparkSession, glob: str) -> DataFrame:
    """path, modified_at, length, content. Listings that don't select content never read it."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(glob)
    return f.select("path", F.col("modificationTime").alias("modified_at"), "length", "content")


def bare_repositories(files: DataFrame) -> DataFrame:
    """Folders that hold a HEAD file beside objects/ and refs/."""
    at = F.regexp_extract("path", r"^(.*)/(HEAD|objects/.*|refs/.*)$", 1)
    part = F.regexp_extract("path", r"^(.*)/(HEAD|objects|refs)(?:/.*)?$", 2)
    per = files.select(at.alias("folder"), part.alias("part")).filter("folder <> ''").groupBy("folder").agg(F.collect_set("part").alias("parts"))
    return per.filter(F.size("parts") == 3).select("folder")


def exclusion(path: Column) -> Column:
    """Why a file isn't taken: folder, hidden folder, extension, unknown kind; null if it is."""
    folders = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(1)))
    suffix = tx.file_suffix(path)
    return (
        F.when(F.exists(folders, lambda x: x.isin(EXCLUDED_FOLDERS)), "folder")
        .when(F.exists(folders, lambda x: x.startswith(".") & (F.length(x) > 1)), "hidden folder")
        .when(suffix.isin(EXCLUDED_EXTENSIONS), "extension")
        .when(kind_of(path).isNull(), "unknown kind")
    )


def excluded_file_report(files: DataFrame, root: str = "") -> DataFrame:
    rel = F.substring("path", len(root) + 1, 1 << 20)
    return files.select(exclusion(rel).alias("reason"), "length").filter("reason is not null").groupBy("reason").agg(F.count("*").alias("n"), F.sum("length").alias("bytes"))


def changed_files(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose path, time and size aren't known; decided before content is read."""
    return files.join(known.select("path", "modified_at", "length"), ["path", "modified_at", "length"], "left_anti")


def scan_files(files: DataFrame, root: str = "", source_id: str = "files") -> DataFrame:
    """Items of class File: the path is the identity, the bytes' hash the content; short texts are inlined."""
    rel = F.substring("path", len(root) + 1, 1 << 20)
    f = files.withColumn("_rel", rel).withColumn("_kind", kind_of(rel)).filter(exclusion(rel).isNull())
    bare = bare_repositories(files)
    f = f.join(bare, F.startswith(f["path"], F.concat(bare["folder"], F.lit("/"))), "left_anti")
    body = F.when(F.col("_kind").isin(INLINE_KINDS) & (F.col("length") <= INLINE_BYTES), F.try_validate_utf8(F.col("content").cast("string")))
    return f.select(*item(source_id, None, F.col("_rel"), "File", F.substring_index("_rel", "/", -1), body, F.sha2("content", 256), F.col("_rel"), modified=F.col("modified_at"), metadata=F.to_json(F.struct(F.col("_kind").alias("kind"), "length"))))


def scan_vault(files: DataFrame, root: str = "", source_id: str = "vault") -> tuple[DataFrame, DataFrame]:
    """(items of class Note, links: source_path, target, type) of markdown files: head, tags, links, dates, words."""
    rel = F.substring("path", len(root) + 1, 1 << 20)
    notes = files.filter(F.lower("path").endswith(".md")).select(rel.alias("rel"), "modified_at", F.col("content").cast("string").alias("text"), F.sha2("content", 256).alias("digest"))
    notes = notes.withColumn("head", tx.frontmatter("text")).withColumn("stem", tx.file_stem(F.col("rel")))
    own = F.coalesce(F.filter(F.split(F.coalesce(F.col("head")["tags"], F.lit("")), ","), lambda x: x != ""), F.array().cast("array<string>"))
    facts = F.to_json(F.struct(F.array_distinct(F.concat(own, tx.hash_tags(F.col("text")))).alias("tags"), tx.note_date(F.col("stem")).alias("date"), tx.word_count(F.col("text")).alias("words")))
    items = notes.select(*item(source_id, None, F.col("rel"), "Note", F.coalesce(F.col("head")["title"], F.col("stem")), F.col("text"), F.sha2(F.concat_ws("|", "digest", "stem", F.lit("parse2")), 256), F.col("rel"), modified=F.col("modified_at"), metadata=facts))
    wiki = notes.select("rel", F.explode(tx.wikilinks(F.col("text"))).alias("l")).select(F.col("rel").alias("source_path"), F.col("l.target").alias("target"), F.when(F.col("l.bang"), "EMBEDS").otherwise("LINKS_TO").alias("type"))
    plain = notes.select(F.col("rel").alias("source_path"), F.explode(tx.markdown_links(F.col("text"))).alias("target"), F.lit("LINKS_TO").alias("type"))
    return items, wiki.unionByName(plain).distinct()


def scan_notes_export(files: DataFrame, root: str = "", source_id: str = "pages_export") -> DataFrame:
    """Pages, databases and files of a note-workspace export: 32 hex digits at the end of the name are the identity,
    else the path, flagged; the title is part of the content, so a rename is a version."""
    rel = F.substring("path", len(root) + 1, 1 << 20)
    stem = tx.file_stem(rel)
    found = F.lower(F.regexp_extract(stem, r"[ _-]([0-9a-fA-F]{32})(?:_all)?$", 1))
    title = F.regexp_replace(stem, r"[ _-][0-9a-fA-F]{32}(?:_all)?$", "")
    kind = F.when(tx.file_suffix(rel) == ".md", "Page").when(tx.file_suffix(rel) == ".csv", "Database").otherwise("File")
    body = F.when(kind != "File", F.try_validate_utf8(F.col("content").cast("string")))
    digest = F.sha2(F.concat_ws("|", F.sha2("content", 256), title), 256)
    return files.select(*item(source_id, None, F.coalesce(F.nullif(found, F.lit("")), rel), kind, title, body, digest, rel, modified=F.col("modified_at"), metadata=F.to_json(F.struct((found == "").alias("path_identity")))))


def notes_export_edges(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """items: what scan_notes_export gives. (LINKS_TO edges: source_native, target_native, type, by the 32 digits in links
    of the bodies; PART_OF edges of each page to the page whose folder it lies in). Only ends that are items count."""
    known = items.select(F.col("native_id").alias("target_native")).distinct()
    href = F.explode(F.regexp_extract_all("body", F.lit(r"\]\(([^)\s]+)"), F.lit(1)))
    links = items.select(F.col("native_id").alias("source_native"), href.alias("h")).select("source_native", tx.link_id(F.col("h")).alias("target_native")).filter("target_native is not null and source_native <> target_native").distinct()
    folder = F.lower(F.regexp_extract("native_path", r"[ _-]([0-9a-fA-F]{32})/[^/]*$", 1))
    part = items.select(F.col("native_id").alias("source_native"), folder.alias("target_native")).filter("target_native <> '' and source_native <> target_native").distinct()
    tag = lambda rows, kind: rows.join(known, "target_native", "left_semi").select("source_native", "target_native", F.lit(kind).alias("type"))
    return tag(links, "LINKS_TO"), tag(part, "PART_OF")
