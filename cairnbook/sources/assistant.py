"""What an assistant's account export holds beside its conversations: attachments, projects, memory, sign-ins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnbook.functions.times import ts_iso
from cairnbook.operators.nested import children, json_kind
from cairnbook.sources.items import item

SOURCE = "assistant"


def _key(prefix: str, *parts: Column) -> Column:
    return F.concat_ws(":", F.lit(prefix), *[p.cast("string") for p in parts])


def _edges(rows: DataFrame, source: Column, target: Column, kind: str) -> DataFrame:
    return rows.select(source.alias("source_native"), target.alias("target_native"), F.lit(kind).alias("type"))


def scan_attachments(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """conversations: chat_messages array<struct<uuid, created_at, attachments array<struct<file_name, extracted_content,
    file_type>>, files array<struct<file_uuid, file_name>>>>. Returns (items, ATTACHED_TO edges to the messages): an
    attachment's identity is its message and place; a file is a name only, since the export has no bytes of it."""
    m = conversations.select(F.explode("chat_messages").alias("m")).select("m.*")
    a = m.select("uuid", "created_at", F.posexplode("attachments").alias("i", "a"))
    native = _key("attachment", F.col("uuid"), F.col("i"))
    name = F.coalesce("a.file_name", F.format_string("(unnamed attachment %d)", "i"))
    kept = a.select(*item(SOURCE, None, native, "Attachment", name, F.col("a.extracted_content"), created=ts_iso(F.col("created_at")), metadata=F.to_json(F.struct(F.col("a.file_type").alias("file_type"), F.lit("THIRD_PARTY").alias("license")))))
    f = m.select("uuid", "created_at", F.explode("files").alias("f"))
    reference = _key("file_ref", F.col("f.file_uuid"))
    named = f.select(*item(SOURCE, None, reference, "FileReference", F.coalesce("f.file_name", F.lit("(uploaded file, bytes not exported)")), created=ts_iso(F.col("created_at")), metadata=F.to_json(F.struct(F.lit(False).alias("bytes_available")))))
    edges = _edges(a, native, _key("message", F.col("uuid")), "ATTACHED_TO").unionByName(_edges(f, reference, _key("message", F.col("uuid")), "ATTACHED_TO"))
    return kept.unionByName(named), edges


def scan_projects(projects: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """projects: uuid, name, description, prompt_template, is_private, created_at, updated_at, docs array<struct<uuid,
    filename, content, created_at>>. Returns (items of projects and their documents, PART_OF edges, workspaces)."""
    told = lambda c: F.when(F.trim(c) != "", c)
    body = F.concat_ws("\n\n", told(F.col("description")), F.concat(F.lit("Custom instructions:\n"), told(F.col("prompt_template"))))
    native = _key("project", F.col("uuid"))
    heads = projects.select(*item(SOURCE, None, native, "Project", F.coalesce("name", native), told(body), created=ts_iso(F.col("created_at")), modified=ts_iso(F.col("updated_at")), metadata=F.to_json(F.struct("is_private", F.coalesce(F.size("docs"), F.lit(0)).alias("docs")))))
    d = projects.select("uuid", F.explode("docs").alias("d"))
    doc = _key("project_doc", F.coalesce("d.uuid", "d.filename"))
    docs = d.select(*item(SOURCE, None, doc, "ProjectDocument", F.coalesce("d.filename", doc), F.col("d.content"), created=ts_iso(F.col("d.created_at"))))
    workspaces = projects.select(F.col("uuid").alias("workspace_id"), F.col("name").alias("display_name"), F.when(F.col("is_private"), "private").otherwise("shared").alias("permission_level"))
    return heads.unionByName(docs), _edges(d, doc, native, "PART_OF"), workspaces


def scan_memory(files: DataFrame, account: str) -> tuple[DataFrame, DataFrame]:
    """files: path, text (JSON). Returns (items, foreign: paths of files that are another account's, never read). The
    account's own file is read; only without it others that bear no account's name. Memory is a narrative, maps of
    slots (named key/key), and files of its own, which keep their path and time."""
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"\.json$", "")
    judged = files.withColumn("_stem", stem).withColumn("_rank", F.when(F.col("_stem") == account, 0).when(F.col("_stem").rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"), 2).otherwise(1))
    first = judged.filter("_rank < 2").agg(F.min_by("path", F.struct("_rank", "path")).alias("path"))
    root = judged.join(first, "path").select("path", F.try_parse_json("text").alias("v")).filter("v is not null")
    entry = root.select("path", F.explode(F.when(json_kind(F.col("v")) == "array", F.transform(children(F.col("v")), lambda c: F.struct(c["pos"].alias("i"), c["value"].alias("v")))).otherwise(F.array(F.struct(F.lit(0).alias("i"), F.col("v").alias("v"))))).alias("e"))
    pairs = entry.select("path", "e.i", F.explode(children(F.col("e.v"))).alias("c")).select("path", "i", "c.key", "c.value").filter("key <> 'account_uuid'")
    string = lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
    text = lambda v: F.coalesce(string(v), F.when(~F.to_json(v).isin("null", "false", "0", '""', "[]", "{}"), F.to_json(v)))
    plain = pairs.select("path", "i", F.col("key").alias("slot"), string(F.col("value")).alias("text"))
    maps = pairs.filter(json_kind(F.col("value")) == "object").select("path", "i", "key", F.explode(children(F.col("value"))).alias("c"))
    slots = plain.unionByName(maps.select("path", "i", F.concat_ws("/", "key", "c.key").alias("slot"), text(F.col("c.value")).alias("text"))).filter("trim(text) <> ''")
    told = F.to_json(F.struct(F.lit("SYNTHESIZED").alias("knowledge_state"), F.lit("UNVERIFIED").alias("decay_status")))
    out = slots.select(*item(SOURCE, F.lit(account), _key("memory", F.col("slot"), F.col("i")), "AssistantMemory", F.concat(F.lit("Assistant memory: "), "slot"), F.col("text"), path=F.col("path"), metadata=told))
    get = lambda k: F.try_variant_get("d", f"$.{k}", "string")
    docs = pairs.filter("key = 'memory_files'").select("path", F.explode(F.try_variant_get("value", "$", "array<variant>")).alias("d")).select("path", get("path").alias("at"), get("content").alias("content"), get("updated_at").alias("updated_at")).filter("content <> ''")
    kept = docs.select(*item(SOURCE, F.lit(account), _key("memory_file", F.col("at")), "AssistantMemory", F.concat(F.lit("Assistant memory file "), "at"), F.col("content"), path=F.col("path"), modified=ts_iso(F.col("updated_at")), metadata=told))
    return out.unionByName(kept), judged.filter("_rank = 2").select("path")


def scan_logins(events: DataFrame, account: str) -> tuple[DataFrame, DataFrame]:
    """events: timestamp, method, ip_address, account_uuid, user_agent struct<browser_family, browser_version, os_family,
    os_version>, location_info struct<city, region, country>. Returns (items, those of other accounts): a sign-in is
    rendered as text and is sensitive."""
    foreign = F.coalesce(F.col("account_uuid") != account, F.lit(False))
    told = lambda c: F.when(c != "", c)
    or_ = lambda c, other: F.coalesce(told(c), F.lit(other))
    where = or_(F.concat_ws(", ", *[told(F.col(f"location_info.{c}")) for c in ("city", "region", "country")]), "unknown location")
    ua = [told(F.col(f"user_agent.{c}")) for c in ("browser_family", "browser_version", "os_family", "os_version")]
    device = F.concat_ws(" ", ua[0], ua[1], F.lit("on"), ua[2], ua[3])
    body = F.concat(F.lit("Sign-in\nwhen   : "), or_(F.col("timestamp"), "?"), F.lit("\nmethod : "), or_(F.col("method"), "unknown"), F.lit("\nfrom   : "), or_(F.col("ip_address"), "unknown ip"), F.lit(" ("), where, F.lit(")\ndevice : "), device)
    mine = events.filter(~foreign).select(*item(SOURCE, F.lit(account), _key("login", F.col("timestamp")), "LoginEvent", F.concat(F.lit("Sign-in "), F.substring(or_(F.col("timestamp"), "?"), 1, 19), F.lit(" from "), where), body, created=ts_iso(F.col("timestamp")), modified=ts_iso(F.col("timestamp")), metadata=F.to_json(F.struct(F.lit("SENSITIVE").alias("classification")))))
    return mine, events.filter(foreign)


SIDECAR = r"-(?:info|metadata)\.json$"


def scan_drive(files: DataFrame, sidecars: DataFrame) -> DataFrame:
    """files: path, content_hash, length, text. sidecars: path, title, url, created_date, modified_date, of files whose
    name goes on with -info.json or -metadata.json. Items of the files; sidecars are none, and their title wins."""
    s = sidecars.groupBy(F.regexp_replace("path", SIDECAR, "").alias("_of")).agg(F.min_by(F.struct("title", "url", "created_date", "modified_date"), "path").alias("s"))
    met = files.filter(~F.col("path").rlike(SIDECAR)).join(s, F.col("path") == F.col("_of"), "left")
    readable = F.lower("path").rlike(r"\.(txt|md|csv|json|html)$")
    body = F.when(readable, F.substring("text", 1, 200_000))
    return met.select(*item("drive", None, _key("drive", F.col("path")), "File", F.coalesce("s.title", F.substring_index("path", "/", -1)), body, F.col("content_hash"), F.col("path"), F.col("s.url"), ts_iso(F.col("s.created_date")), ts_iso(F.col("s.modified_date")), F.to_json(F.struct(F.col("length").alias("bytes")))))


def declare_mail_archives(files: DataFrame) -> DataFrame:
    """files: path, content_hash, length. Mail archives are registered by their bytes and not read."""
    f = files.filter(F.lower("path").endswith(".mbox"))
    return f.select(*item("mail", None, _key("mail_archive", F.col("path")), "MailArchive", F.substring_index("path", "/", -1), None, F.col("content_hash"), F.col("path"), metadata=F.to_json(F.struct(F.col("length").alias("bytes"), F.lit(False).alias("interpreted")))))


def scan_databases(files: DataFrame) -> DataFrame:
    """files: path, text (CSV). An item per file with its columns and number of rows; line breaks inside quotes are no
    rows."""
    bare = F.regexp_replace("text", '"(?:[^"]|"")*"', "q")
    lines = F.filter(F.split(bare, r"\r?\n"), lambda x: F.trim(x) != "")
    head = F.regexp_extract("text", r'^\x{FEFF}?((?:"(?:[^"]|"")*"|[^"\r\n])*)', 1)
    columns = F.transform(F.regexp_extract_all(F.concat(head, F.lit(",")), F.lit(r'("(?:[^"]|"")*"|[^",]*),'), F.lit(1)), lambda c: F.replace(F.regexp_replace(c, '^"|"$', ""), F.lit('""'), F.lit('"')))
    facts = F.to_json(F.struct(F.greatest(F.size(lines) - 1, F.lit(0)).alias("row_count"), columns.alias("columns")))
    return files.select(*item("notes", None, _key("database", F.col("path")), "Database", F.regexp_replace(F.substring_index("path", "/", -1), r"\.csv$", ""), path=F.col("path"), metadata=facts))
