"""Exports that are JSON: histories, notes, stars, chats, bases, workflows, audits, social records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnbook.functions.lineage import fixed
from cairnbook.functions.times import chrome_ts, from_epoch, ts_iso
from cairnbook.operators.nested import children
from cairnbook.sources.items import item


def scan_browser_history(history: DataFrame) -> DataFrame:
    """history: `Browser History` array<struct<title, url, time_usec, …>>. Visits: url, ts, title, kind."""
    rows = history.select(F.explode("Browser History").alias("h"))
    return rows.select(F.col("h.url").alias("url"), chrome_ts(F.col("h.time_usec")).alias("ts"), F.col("h.title").alias("title"), F.lit("history").alias("kind")).filter("url is not null")


def scan_activity(rows: DataFrame) -> DataFrame:
    """rows: title, titleUrl, time, path. Visits only; the product is the folder; rows without a URL are skipped."""
    product = F.element_at(F.split("path", "/"), -2)
    return rows.filter("titleUrl is not null").select(F.col("titleUrl").alias("url"), ts_iso(F.col("time")).alias("ts"), "title", F.lit("activity").alias("kind"), product.alias("product"))


def scan_keep(notes: DataFrame) -> DataFrame:
    """Notes with their text and checklist, labels and flags."""
    lines = F.transform(F.coalesce("listContent", F.array().cast("array<struct<text:string,isChecked:boolean>>")), lambda x: F.concat(F.when(x["isChecked"], F.lit("[x] ")).otherwise(F.lit("[ ] ")), F.coalesce(x["text"], F.lit(""))))
    body = F.concat_ws("\n", F.nullif(F.col("textContent"), F.lit("")), F.nullif(F.array_join(lines, "\n"), F.lit("")))
    facts = F.to_json(F.struct(F.transform(F.col("labels"), lambda x: x["name"]).alias("labels"), F.col("isPinned").alias("pinned")))
    return notes.select(*item("keep", F.col("account_id"), F.col("path"), "Note", F.col("title"), body, path=F.col("path"), created=from_epoch(F.col("createdTimestampUsec")), modified=from_epoch(F.col("userEditedTimestampUsec")), metadata=facts))


def scan_calendar(files: DataFrame) -> DataFrame:
    """files: path, text. Calendars as a whole, with their number of events."""
    return files.select(*item("calendar", None, F.col("path"), "Calendar", F.substring_index("path", "/", -1), F.col("text"), path=F.col("path"), metadata=F.to_json(F.struct(F.regexp_count("text", F.lit("BEGIN:VEVENT")).alias("events")))))


def calendar_events(files: DataFrame) -> DataFrame:
    """files: path, text (iCalendar). A row per event: path, n (its place), uid, summary, starts, ends, location. Folded
    lines are joined, escapes undone; parameters of a property are passed over; times are as written."""
    text = F.regexp_replace(F.regexp_replace("text", "\r\n", "\n"), "\n[ \t]", "")
    blocks = F.regexp_extract_all(text, F.lit(r"(?s)BEGIN:VEVENT\n(.*?)END:VEVENT"), F.lit(1))
    e = files.select("path", F.posexplode(blocks).alias("n", "b"))
    kept = F.lit("\x01")  # stands for a double backslash, so that what follows one isn't taken for its escape
    plain = lambda c: F.replace(F.regexp_replace(F.regexp_replace(F.replace(F.replace(c, F.lit("\r"), F.lit("")), F.lit("\\\\"), kept), r"\\[nN]", "\n"), r"\\([,;])", "$1"), kept, F.lit("\\"))
    get = lambda name: plain(F.nullif(F.regexp_extract("b", rf"(?m)^{name}(?:;[^:\n]*)?:(.*)$", 1), F.lit("")))
    return e.select("path", "n", get("UID").alias("uid"), get("SUMMARY").alias("summary"), get("DTSTART").alias("starts"), get("DTEND").alias("ends"), get("LOCATION").alias("location"))


def scan_canvas(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """files: path, text (JSON). (nodes: path, node, kind, text — of a card its text, of a file its path, of a link its
    address, of a group its label; edges: path, source, target, label). A broken file has neither."""
    kind = "nodes array<struct<id:string,type:string,text:string,file:string,url:string,label:string>>, edges array<struct<fromNode:string,toNode:string,label:string>>"
    c = files.select("path", F.from_json("text", kind).alias("c"))
    n = c.select("path", F.explode("c.nodes").alias("n"))
    e = c.select("path", F.explode("c.edges").alias("e"))
    nodes = n.select("path", F.col("n.id").alias("node"), F.col("n.type").alias("kind"), F.coalesce("n.text", "n.file", "n.url", "n.label").alias("text"))
    return nodes, e.select("path", F.col("e.fromNode").alias("source"), F.col("e.toNode").alias("target"), F.col("e.label").alias("label"))


def undated_stars(rows: DataFrame) -> DataFrame:
    """The older form, repositories without the time of their star, in the shape of the newer."""
    fields = ["full_name", "html_url", "description", "language", "topics"]
    return rows.select(F.lit(None).cast("string").alias("starred_at"), F.struct(*fields).alias("repo"))


def star_visits(rows: DataFrame) -> DataFrame:
    """A repository is a referenced URL, at the time of its star if there is one."""
    return rows.filter("repo.html_url is not null").select(F.col("repo.html_url").alias("url"), ts_iso(F.col("starred_at")).alias("ts"), F.col("repo.full_name").alias("title"), F.lit("referenced").alias("kind"))


def scan_stars(rows: DataFrame) -> DataFrame:
    """rows: starred_at, repo struct<full_name, html_url, description, language, topics, …>."""
    r = F.col("repo")
    body = F.concat_ws("\n", r["description"], F.concat(F.lit("topics: "), F.array_join(r["topics"], ", ")), F.concat(F.lit("language: "), r["language"]))
    return rows.select(*item("stars", None, r["full_name"], "Repository", r["full_name"], body, url=r["html_url"], created=ts_iso(F.col("starred_at"))))


def scan_chat_tree(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """conversations: conversation_id, title, current_node, mapping map<id, struct<parent, children, message>>. Returns
    (messages: conversation_id, node, parent, role, body, created_at; items of the conversations)."""
    nodes = conversations.select("conversation_id", F.explode("mapping").alias("node", "n"))
    parts = F.filter(F.coalesce(F.col("n.message.content.parts"), F.array().cast("array<string>")), lambda x: x.isNotNull())
    messages = nodes.filter("n.message is not null").select("conversation_id", "node", F.col("n.parent").alias("parent"), F.col("n.message.author.role").alias("role"), F.nullif(F.array_join(parts, "\n"), F.lit("")).alias("body"), from_epoch(F.col("n.message.create_time")).alias("created_at"))
    items = conversations.select(*item("chats", None, F.col("conversation_id"), "Conversation", F.col("title")))
    return messages, items


def current_branch(conversations: DataFrame, nodes: DataFrame) -> DataFrame:
    """nodes: conversation_id, node, parent (and children, an array, if the export has it). Adds on_current_branch: the
    way from current_node up to the root; where there is no such node, from the root down, always to the last child.
    Doubling steps: after k rounds a node knows the one 2**k steps on, so depth costs its logarithm, not a loop over
    turns; a broken export whose parents form a cycle ends when no node is new."""
    id_ = "conversation_id"
    known = conversations.join(nodes.select(id_, F.col("node").alias("current_node")).distinct(), [id_, "current_node"], "left_semi").select(id_, F.col("current_node").alias("node"))
    up = nodes.filter("parent is not null").select(id_, "node", F.col("parent").alias("to")).join(known.select(id_), id_, "left_semi")
    lost = conversations.select(id_).join(known.select(id_), id_, "left_anti")
    rest = nodes.join(lost, id_, "left_semi")
    roots = rest.filter("parent is null").groupBy(id_).agg(F.min("node").alias("node"))
    last = F.element_at(F.filter("children", lambda x: x.isNotNull()), -1) if "children" in nodes.columns else None
    down = rest.select(id_, "node", last.alias("to")) if last is not None else rest.select(id_, F.col("parent").alias("node"), F.col("node").alias("to")).filter("node is not null").groupBy(id_, "node").agg(F.max("to").alias("to"))
    on, jump, size = known.union(roots), fixed(up.union(down.filter("to is not null")).distinct()), None
    while True:
        step = on.join(jump, [id_, "node"]).select(id_, F.col("to").alias("node"))
        on = fixed(on.union(step).distinct())
        before, size = size, on.count()
        if size == before:
            break
        jump = fixed(jump.alias("a").join(jump.alias("b"), (F.col(f"a.{id_}") == F.col(f"b.{id_}")) & (F.col("a.to") == F.col("b.node"))).select(f"a.{id_}", "a.node", "b.to"))
    marked = on.withColumn("on_current_branch", F.lit(True))
    return nodes.join(marked, [id_, "node"], "left").withColumn("on_current_branch", F.coalesce("on_current_branch", F.lit(False)))


def scan_assistant_chats(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """conversations: uuid, name, account.uuid, chat_messages. Returns (items, edges PART_OF and REPLIES_TO)."""
    m = conversations.select(F.col("uuid").alias("conv"), F.col("account.uuid").alias("account"), F.explode("chat_messages").alias("m"))
    tier = F.when(F.col("m.sender") == "human", "PRIMARY SOURCE").otherwise("AI-GENERATED")
    messages = m.select(*item("assistant", F.col("account"), F.col("m.uuid"), "Message", body=F.col("m.text"), created=ts_iso(F.col("m.created_at")), metadata=F.to_json(F.struct(tier.alias("authority")))))
    first = F.element_at(F.filter("chat_messages", lambda x: x["sender"] == "human"), 1)["text"]
    head = F.concat_ws("\n", F.col("name"), F.concat(F.size("chat_messages").cast("string"), F.lit(" messages")), F.substring(first, 1, 2000))
    heads = conversations.select(*item("assistant", F.col("account.uuid"), F.col("uuid"), "Conversation", F.col("name"), head, created=ts_iso(F.col("created_at")), modified=ts_iso(F.col("updated_at"))))
    part = m.select(F.col("m.uuid").alias("source_native"), F.col("conv").alias("target_native"), F.lit("PART_OF").alias("type"))
    reply = m.filter("m.parent_message_uuid is not null").select(F.col("m.uuid").alias("source_native"), F.col("m.parent_message_uuid").alias("target_native"), F.lit("REPLIES_TO").alias("type"))
    return heads.unionByName(messages), part.unionByName(reply)


def scan_bases(snapshots: DataFrame) -> DataFrame:
    """snapshots: base struct<id, name>, tables array<struct<id, name, records array<struct<id, fields map>>>>. Items of
    classes Database, Table and Record."""
    tables = snapshots.select("base", F.explode("tables").alias("t"))
    records = tables.select("t", F.explode("t.records").alias("r"))
    title = F.coalesce(*[F.col("r.fields")[k] for k in ("Name", "name", "Title", "title")], F.col("r.id"))
    body = F.array_join(F.transform(F.array_sort(F.map_entries("r.fields")), lambda x: F.concat_ws(": ", x["key"], x["value"])), "\n")
    out = snapshots.select(*item("bases", None, F.col("base.id"), "Database", F.col("base.name")))
    out = out.unionByName(tables.select(*item("bases", None, F.col("t.id"), "Table", F.col("t.name"))))
    return out.unionByName(records.select(*item("bases", None, F.col("r.id"), "Record", title, body)))


def scan_workflows(workflows: DataFrame) -> DataFrame:
    """workflows: id, name, nodes array<struct<id, name, type>>. Items of classes Workflow and WorkflowNode."""
    triggers = F.size(F.filter("nodes", lambda n: F.lower(n["type"]).rlike("trigger|webhook")))
    heads = workflows.select(*item("workflows", None, F.col("id"), "Workflow", F.col("name"), F.array_join(F.transform("nodes", lambda n: n["name"]), "\n"), metadata=F.to_json(F.struct(triggers.alias("triggers")))))
    nodes = workflows.select("id", F.explode("nodes").alias("n"))
    return heads.unionByName(nodes.select(*item("workflows", None, F.concat_ws("/", "id", "n.id"), "WorkflowNode", F.col("n.name"), F.col("n.type"))))


def scan_server_audit(audits: DataFrame, expected: list[str]) -> DataFrame:
    """audits: host, generated_at_utc, sections map<string, struct<lines>>. One Source item per audit, at most 200 lines
    of a section in its body, and the expected sections that are missing."""
    body = F.array_join(F.transform(F.array_sort(F.map_entries("sections")), lambda s: F.concat_ws("\n", s["key"], F.array_join(F.slice(s["value"]["lines"], 1, 200), "\n"))), "\n")
    missing = F.array_except(F.array(*map(F.lit, expected)), F.map_keys("sections"))
    return audits.select(*item("audits", None, F.col("host"), "Source", F.col("host"), body, modified=ts_iso(F.col("generated_at_utc")), metadata=F.to_json(F.struct(missing.alias("missing")))))


def scan_social_threads(threads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """threads: thread_path, participants array<struct<name>>, messages array<struct<sender_name, timestamp_ms,
    content>>. Returns (items, PART_OF edges)."""
    names = F.array_join(F.transform("participants", lambda p: p["name"]), " & ")
    heads = threads.select(*item("social", None, F.col("thread_path"), "Conversation", names))
    m = threads.select("thread_path", F.explode("messages").alias("m"))
    native = F.substring(F.sha2(F.concat_ws("|", "thread_path", F.col("m.timestamp_ms").cast("string"), "m.sender_name", "m.content"), 256), 1, 32)
    items = heads.unionByName(m.select(*item("social", None, native, "Message", F.col("m.sender_name"), F.col("m.content"), created=from_epoch(F.col("m.timestamp_ms")))))
    return items, m.select(native.alias("source_native"), F.col("thread_path").alias("target_native"), F.lit("PART_OF").alias("type"))


def scan_tabular(rows: DataFrame, source_id: str, object_class: str, identity: list[str], title: list[str], date: str | None = None) -> DataFrame:
    """Rows of a declared CSV: keyed by their identity columns, whatever their order in the file."""
    pick = lambda cols: F.concat_ws(" ", *[F.col(c).cast("string") for c in cols])
    key = F.substring(F.sha2(F.array_join(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in identity]), "|"), 256), 1, 24)
    body = F.concat_ws("\n", *[F.concat(F.lit(f"{c}: "), F.col(c).cast("string")) for c in sorted(rows.columns)])
    return rows.select(*item(source_id, None, key, object_class, pick(title), body, created=ts_iso(F.col(date)) if date else None))


# Where records of social exports keep their text and time, and marks of rendered blocks.
TEXT_KEYS = ["title", "post", "content", "text", "caption", "name", "value", "description"]
TIME_KEYS = ["timestamp", "creation_timestamp", "timestamp_ms", "taken_at", "time", "date"]
REASONING, TOP_LEVEL, TOOL_CHARS = "[assistant reasoning]", "[export top-level text]", 400


def _first_value(record: str, keys: list[str]):
    """The first value of these keys that isn't null or empty, as a variant."""
    out = F.lit(None).cast("variant")
    for k in reversed(keys):
        v = F.try_variant_get(record, f"$.{k}", "variant")
        out = F.when(v.isNotNull() & ~F.to_json(v).isin("null", '""', "[]", "{}"), v).otherwise(out)
    return out


def _string(v):
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def scan_social_records(files: DataFrame, product: str) -> DataFrame:
    """files: path, text (JSON of unknown schema). Items of the records: those of the list at the root, or of the largest
    list of objects under one of its keys (ties: the first key in order), or the root itself if it has a text or time.
    Threads are another scan's; other files give nothing. A record's text is that of its first text key, the titles of
    its media, its labelled values and its data, in this order, without repeats; its time is looked for likewise.
    Identity is content, never the place in the file."""
    docs = files.select("path", F.try_parse_json("text").alias("v")).filter("v is not null")
    list_of = lambda v: F.try_variant_get(v, "$", "array<variant>")
    is_object = lambda v: F.schema_of_variant(v).startswith("OBJECT")
    thread = F.try_variant_get("v", "$.messages", "array<variant>").isNotNull() & F.try_variant_get("v", "$.participants", "variant").isNotNull()
    roots = docs.filter(F.schema_of_variant("v").startswith("ARRAY")).select("path", list_of("v").alias("records"))
    whole = docs.filter(is_object(F.col("v")) & ~F.coalesce(thread, F.lit(False)))
    keyed = whole.select("path", F.explode(children(F.col("v"))).alias("c")).select("path", "c.pos", list_of("c.value").alias("records"))
    keyed = keyed.filter((F.size("records") > 0) & F.forall("records", is_object))
    best = keyed.groupBy("path").agg(F.max_by("records", F.struct(F.size("records"), -F.col("pos"))).alias("records"))
    single = F.lit(False)
    for k in TEXT_KEYS + TIME_KEYS:
        single = single | F.try_variant_get("v", f"$.{k}", "variant").isNotNull()
    alone = whole.filter(single).join(best.select("path"), "path", "left_anti").select("path", F.array("v").alias("records"))
    r = roots.unionByName(best).unionByName(alone).select("path", F.explode("records").alias("r")).filter(is_object(F.col("r")))
    media = F.coalesce(F.try_variant_get("r", "$.media", "array<variant>"), F.array().cast("array<variant>"))
    labels = F.coalesce(F.map_entries(F.try_variant_get("r", "$.string_map_data", "map<string,variant>")), F.array().cast("array<struct<key:string,value:variant>>"))
    data = F.coalesce(F.try_variant_get("r", "$.data", "array<variant>"), F.array().cast("array<variant>"))
    get = lambda v, k: F.try_variant_get(v, f"$.{k}", "string")
    bits = F.concat(
        F.array(_string(_first_value("r", TEXT_KEYS))), F.transform(media, lambda m: get(m, "title")),
        F.transform(labels, lambda x: F.when(get(x["value"], "value") != "", F.concat(x["key"], F.lit(": "), get(x["value"], "value")))),
        F.flatten(F.transform(data, lambda x: F.array(*[_string(F.try_variant_get(x, f"$.{k}", "variant")) for k in TEXT_KEYS]))),
    )
    text = F.trim(F.array_join(F.array_distinct(F.filter(bits, lambda b: b != "")), "\n"))
    first = lambda values: F.try_element_at(F.filter(values, lambda x: x.isNotNull()), F.lit(1))
    when = F.coalesce(F.try_variant_get(_first_value("r", TIME_KEYS), "$", "string"), first(F.transform(labels, lambda x: get(x["value"], "timestamp"))), first(F.transform(media, lambda m: get(m, "creation_timestamp"))))
    out = r.select("path", text.alias("body"), when.alias("when"))
    at = F.when(F.col("when").rlike("^[0-9]+$"), from_epoch(F.col("when").try_cast("double"))).otherwise(ts_iso(F.col("when")))
    native = F.concat_ws(":", F.lit(product), "path", F.substring(F.sha2(F.concat_ws("|", F.coalesce("when", F.lit("")), "body"), 256), 1, 24))
    title = F.when(F.col("body") != "", F.replace(F.substring("body", 1, 120), F.lit("\n"), F.lit(" "))).otherwise(F.substring_index("path", "/", -1))
    return out.select(*item("social", None, native, "Record", title, F.nullif("body", F.lit("")), path=F.col("path"), created=at, modified=at))


def render_blocks(content, text):
    """The canonical text of an assistant message: its content blocks in order (array of struct<type, text, thinking, name,
    integration_name, input, content, is_error>; input and content as JSON), and the top-level text only where it differs
    from the text blocks in more than white space. Null without either."""
    nonempty = lambda c: F.when(c != "", c)
    name = lambda b: F.coalesce(nonempty(b["name"]), F.lit("tool"))
    used = lambda b: F.concat(F.lit("[tool_use: "), name(b), F.coalesce(F.concat(F.lit(" via "), nonempty(b["integration_name"])), F.lit("")), F.lit("] "), F.coalesce(F.substring(b["input"], 1, TOOL_CHARS), F.lit("")))
    result = lambda b: F.concat(F.lit("[tool_result: "), name(b), F.when(b["is_error"], " ERROR").otherwise(""), F.lit(", "), F.coalesce(F.length(b["content"]), F.lit(0)).cast("string"), F.lit(" chars - full payload in evidence]"))
    shown = lambda b: (
        F.when(b["type"] == "text", nonempty(b["text"])).when(b["type"] == "thinking", F.concat(F.lit(REASONING + "\n"), nonempty(b["thinking"])))
        .when(b["type"] == "tool_use", used(b)).when(b["type"] == "tool_result", result(b)).when(b["type"] != "token_budget", F.concat(F.lit("["), b["type"], F.lit(" block]")))
    )
    blocks = F.coalesce(content, F.filter(content, lambda b: F.lit(False)))
    texts = F.filter(F.transform(blocks, lambda b: F.when(b["type"] == "text", nonempty(b["text"]))), lambda x: x.isNotNull())
    squeezed = lambda c: F.regexp_replace(c, r"\s+", "")
    top = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    extra = F.when((top != "") & (squeezed(top) != squeezed(F.coalesce(F.array_join(texts, ""), F.lit("")))), F.when(F.coalesce(F.size(texts), F.lit(0)) > 0, F.concat(F.lit(TOP_LEVEL + "\n"), top)).otherwise(top))
    parts = F.filter(F.concat(F.coalesce(F.transform(blocks, shown), F.array().cast("array<string>")), F.array(extra)), lambda x: x.isNotNull())
    return nonempty(F.regexp_replace(F.array_join(parts, "\n\n"), r"^\s+|\s+$", ""))
