"""Registered scans and sinks. Exports in the shapes that the scans read are put together from the driver's tables inside
each query, so their number grows with the tables; their SQL says what must come out, from the tables alone."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnbook.operators import sinks
from cairnbook.plans.registry import query
from cairnbook.plans.tables import read
from cairnbook.sources import markup, records
from cairnbook.sources.items import dataset_tag

#: Rows of a made file, about.
FILE_ROWS = 100


def _conversations(s, d):
    """One row per conversation: its turns in order. A conversation has few turns."""
    t = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return read(s, d, "conversations").groupBy("conv_id").agg(t.alias("turns"))


_NODE = lambda c, t: F.concat_ws("-", F.lit("n"), c.cast("string"), t.cast("string"))


def _chat_exports(s, d):
    """Chat trees: every fourth turn answers the turn before the last, whose answer stays as an abandoned branch."""
    up = lambda t: F.when((t % 4 == 3), t - 2).when(t > 0, t - 1)
    message = lambda x: F.struct(F.struct(x["role"].alias("role")).alias("author"), F.struct(F.array(F.lit("part"), x["text"]).alias("parts")).alias("content"), x["turn"].cast("double").alias("create_time"))
    entry = lambda x: F.struct(_NODE(F.col("conv_id"), x["turn"]), F.struct(F.when(up(x["turn"]).isNotNull(), _NODE(F.col("conv_id"), up(x["turn"]))).alias("parent"), message(x).alias("message")))
    c = _conversations(s, d)
    return c.select(F.col("conv_id").cast("string").alias("conversation_id"), F.lit("chat").alias("title"), _NODE(F.col("conv_id"), F.array_max("turns.turn")).alias("current_node"), F.map_from_entries(F.transform("turns", entry)).alias("mapping"))


@query("S05_bookmarks", f"SELECT url AS href, 'P & ' || page_id AS title, page_id AS add_date, 'Bar/Folder ' || (page_id // {FILE_ROWS}) AS folder FROM pages")
def _(s, d):
    anchor = F.concat(F.lit('<DT><A HREF="'), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit('" ADD_DATE="'), F.col("page_id").cast("string"), F.lit('">P &amp; '), F.col("page_id").cast("string"), F.lit("</A>"))
    files = read(s, d, "pages").groupBy(F.expr(f"page_id div {FILE_ROWS}").alias("k")).agg(F.collect_list(anchor).alias("a"))
    text = F.concat(F.lit("<H1>Bookmarks</H1><DL><p><DT><H3>Bar</H3><DL><p><DT><H3>Folder "), F.col("k").cast("string"), F.lit("</H3>\n<DL><p>"), F.array_join("a", "\n"), F.lit("</DL></DL></DL>"))
    return markup.scan_bookmarks(files.select(F.col("k").cast("string").alias("path"), text.alias("text"))).select("href", "title", "add_date", "folder")


@query("S06_browser_history", "SELECT 'http://site' || user_id || '.example/' AS url, date_trunc('second', ts) AS ts, event_type AS title, 'history' AS kind FROM events")
def _(s, d):
    usec = F.unix_seconds(F.col("ts").cast("timestamp")) * 1_000_000 + 11_644_473_600_000_000
    visit = F.struct(F.col("event_type").alias("title"), F.format_string("http://site%d.example/", "user_id").alias("url"), usec.alias("time_usec"))
    files = read(s, d, "events").groupBy(F.expr(f"event_id div {FILE_ROWS}")).agg(F.collect_list(visit).alias("Browser History"))
    return records.scan_browser_history(files).select("url", F.col("ts").cast("timestamp_ntz").alias("ts"), "title", "kind")


@query("S08_keep_notes", "SELECT 'Keep/' || c_custkey || '.json' AS native_id, c_name AS title, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment || chr(10) END || '[x] call' || chr(10) || '[ ] pay ' || c_nationkey AS body FROM customer")
def _(s, d):
    c = read(s, d, "customer")
    todo = F.array(F.struct(F.lit("call").alias("text"), F.lit(True).alias("isChecked")), F.struct(F.concat(F.lit("pay "), F.col("c_nationkey").cast("string")).alias("text"), F.lit(False).alias("isChecked")))
    notes = c.select(F.concat(F.lit("Keep/"), F.col("c_custkey").cast("string"), F.lit(".json")).alias("path"), F.lit("a").alias("account_id"), F.col("c_name").alias("title"), F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_mktsegment")).alias("textContent"), todo.alias("listContent"), F.array(F.struct(F.lit("l").alias("name"))).alias("labels"), F.lit(True).alias("isPinned"), F.lit(0).cast("long").alias("createdTimestampUsec"), F.lit(0).cast("long").alias("userEditedTimestampUsec"))
    return records.scan_keep(notes).select("native_id", "title", "body")


@query("S09_calendars", "SELECT 'cal/' || s_suppkey || '.ics' AS native_id, s_suppkey || '.ics' AS title, '{\"events\":' || (s_suppkey % 5) || '}' AS raw_metadata FROM supplier")
def _(s, d):
    n = (F.col("s_suppkey") % 5).cast("int")
    files = read(s, d, "supplier").select(F.concat(F.lit("cal/"), F.col("s_suppkey").cast("string"), F.lit(".ics")).alias("path"), F.concat(F.lit("BEGIN:VCALENDAR\n"), F.repeat(F.lit("BEGIN:VEVENT\nEND:VEVENT\n"), n), F.lit("END:VCALENDAR")).alias("text"))
    return records.scan_calendar(files).select("native_id", "title", "raw_metadata")


@query("S10_activity", "SELECT 'http://site' || user_id || '.example/' AS url, event_type AS title, 'activity' AS kind, 'P' || (event_id % 3) AS product FROM events WHERE event_id % 4 <> 0")
def _(s, d):
    e = read(s, d, "events")
    url = F.when(F.col("event_id") % 4 != 0, F.format_string("http://site%d.example/", "user_id"))
    rows = e.select(F.col("event_type").alias("title"), url.alias("titleUrl"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("time"), F.concat(F.lit("Takeout/P"), (F.col("event_id") % 3).cast("string"), F.lit("/MyActivity.json")).alias("path"))
    return records.scan_activity(rows).select("url", "title", "kind", "product")


@query("S12_mail", "SELECT CASE WHEN c_custkey % 3 = 0 THEN 'sha256:' || substr(sha256('c' || c_custkey || '@mail.example|Order ' || c_custkey || '|Mon, 01 Jan 2024 10:00:00 +0000|Dear ' || c_mktsegment || chr(10)), 1, 32) ELSE '<m' || c_custkey || '@mail.example>' END AS message_id, 'Order ' || c_custkey AS subject, 'c' || c_custkey || '@mail.example' AS sender, 'plain' AS body_part, 'Dear ' || c_mktsegment || chr(10) AS body FROM customer")
def _(s, d):
    k = F.col("c_custkey").cast("string")
    mid = F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.concat(F.lit("Message-ID: <m"), k, F.lit("@mail.example>\n")))
    raw = F.concat(F.lit("From: c"), k, F.lit("@mail.example\nTo: shop@mail.example\nSubject: Order "), k, F.lit("\nDate: Mon, 01 Jan 2024 10:00:00 +0000\n"), mid, F.lit("Content-Type: text/plain\n\nDear "), "c_mktsegment", F.lit("\n"))
    got = markup.parse_messages(read(s, d, "customer").select(F.lit("box").alias("mailbox"), raw.alias("raw")))
    return sinks.split_failures(got)[0].select("message_id", "subject", F.col("from")[0].alias("sender"), "body_part", "body")


@query("S19_stars", "SELECT 'o/' || p_partkey AS native_id, p_name || chr(10) || 'topics: ' || lower(p_type) || ', x' || chr(10) || 'language: ' || p_brand AS body, 'https://code.example/' || p_partkey AS native_url FROM part")
def _(s, d):
    k = F.col("p_partkey").cast("string")
    repo = F.struct(F.concat(F.lit("o/"), k).alias("full_name"), F.concat(F.lit("https://code.example/"), k).alias("html_url"), F.col("p_name").alias("description"), F.col("p_brand").alias("language"), F.array(F.lower("p_type"), F.lit("x")).alias("topics"))
    return records.scan_stars(read(s, d, "part").select(F.lit("2024-01-01T00:00:00Z").alias("starred_at"), repo.alias("repo"))).select("native_id", "body", "native_url")


@query("S20_chat_tree", "SELECT CAST(conv_id AS VARCHAR) AS conversation_id, 'n-' || conv_id || '-' || turn AS node, CASE WHEN turn % 4 = 3 THEN 'n-' || conv_id || '-' || (turn - 2) WHEN turn > 0 THEN 'n-' || conv_id || '-' || (turn - 1) END AS parent, role, 'part' || coalesce(chr(10) || text, '') AS body FROM conversations")
def _(s, d):
    return records.scan_chat_tree(_chat_exports(s, d))[0].select("conversation_id", "node", "parent", "role", "body")


@query("S21_current_branch", "WITH RECURSIVE up AS (SELECT conv_id, max(turn) AS turn FROM conversations GROUP BY 1 UNION SELECT conv_id, CASE WHEN turn % 4 = 3 THEN turn - 2 ELSE turn - 1 END FROM up WHERE turn > 0) SELECT 'n-' || c.conv_id || '-' || c.turn AS node, u.turn IS NOT NULL AS on_current_branch FROM conversations c LEFT JOIN up u ON c.conv_id = u.conv_id AND c.turn = u.turn")
def _(s, d):
    chats = _chat_exports(s, d)
    nodes = records.scan_chat_tree(chats)[0].select("conversation_id", "node", "parent")
    return records.current_branch(chats, nodes).select("node", "on_current_branch")


@query("S22_assistant_chats", "WITH m AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'human' ELSE role END AS sender, text FROM conversations) SELECT 'm' || conv_id || '-' || turn AS native_id, 'Message' AS object_class, text AS body FROM m UNION ALL SELECT 'c' || conv_id, 'Conversation', 'Chat ' || conv_id || chr(10) || count(*) || ' messages' || coalesce(chr(10) || substr(min_by(text, turn) FILTER (WHERE sender = 'human'), 1, 2000), '') FROM m GROUP BY conv_id")
def _(s, d):
    k = F.col("conv_id").cast("string")
    sender = lambda x: F.when(x["role"] == "user", "human").otherwise(x["role"])
    messages = F.transform("turns", lambda x: F.struct(F.concat(F.lit("m"), k, F.lit("-"), x["turn"].cast("string")).alias("uuid"), x["text"].alias("text"), sender(x).alias("sender"), F.lit("2024-01-01T00:00:00Z").alias("created_at"), F.lit(None).cast("string").alias("parent_message_uuid")))
    c = _conversations(s, d).select(F.concat(F.lit("c"), k).alias("uuid"), F.concat(F.lit("Chat "), k).alias("name"), F.struct(F.lit("a").alias("uuid")).alias("account"), F.lit("2024-01-01T00:00:00Z").alias("created_at"), F.lit("2024-01-02T00:00:00Z").alias("updated_at"), messages.alias("chat_messages"))
    return records.scan_assistant_chats(c)[0].select("native_id", "object_class", "body")


@query("S30_csv_rows", f"SELECT 'people-' || (c_custkey // {FILE_ROWS}) || '.csv' AS path, c_name AS name, c_mktsegment || ', \"x\"' AS segment, CAST(c_nationkey AS VARCHAR) AS nation FROM customer")
def _(s, d):
    line = F.concat(F.col("c_name"), F.lit(',"'), F.col("c_mktsegment"), F.lit(', ""x""",'), F.col("c_nationkey").cast("string"))
    files = read(s, d, "customer").groupBy(F.expr(f"c_custkey div {FILE_ROWS}").alias("k")).agg(F.collect_list(line).alias("l"))
    text = F.concat(F.lit("﻿Notes:\nmade by hand\n\nName,Segment,Nation\n"), F.array_join("l", "\n"))
    rows = markup.read_csv_rows(files.select(F.concat(F.lit("people-"), F.col("k").cast("string"), F.lit(".csv")).alias("path"), text.cast("binary").alias("content")))
    return rows.select("path", F.col("row")["Name"].alias("name"), F.col("row")["Segment"].alias("segment"), F.col("row")["Nation"].alias("nation"))


@query("S31_tabular", "SELECT substr(sha256(CAST(o_orderkey AS VARCHAR) || '|' || o_orderstatus), 1, 24) AS native_id, o_orderpriority AS title FROM orders")
def _(s, d):
    return records.scan_tabular(read(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), "shop", "Order", ["o_orderkey", "o_orderstatus"], ["o_orderpriority"]).select("native_id", "title")


@query("S36_server_audit", "SELECT 'host' || n_nationkey AS native_id, 'disk' || chr(10) || n_name || chr(10) || '90%' || CASE WHEN n_nationkey % 2 = 0 THEN chr(10) || 'net' || chr(10) || 'up' ELSE '' END AS body, CASE WHEN n_nationkey % 2 = 0 THEN '{\"missing\":[\"users\"]}' ELSE '{\"missing\":[\"net\",\"users\"]}' END AS raw_metadata FROM nation")
def _(s, d):
    lines = lambda *x: F.struct(F.array(*x).alias("lines"))
    disk, net = F.struct(F.lit("disk"), lines(F.col("n_name"), F.lit("90%"))), F.struct(F.lit("net"), lines(F.lit("up")))
    sections = F.map_from_entries(F.when(F.col("n_nationkey") % 2 == 0, F.array(net, disk)).otherwise(F.array(disk)))
    audits = read(s, d, "nation").select(F.concat(F.lit("host"), F.col("n_nationkey").cast("string")).alias("host"), F.lit("2024-01-01T00:00:00Z").alias("generated_at_utc"), sections.alias("sections"))
    return records.scan_server_audit(audits, ["disk", "net", "users"]).select("native_id", "body", "raw_metadata")


@query("S38_dataset_tag", "SELECT CAST(conv_id AS VARCHAR) AS dataset, substr(sha256(string_agg('t' || turn || ':' || sha256(coalesce(text, '')), '|' ORDER BY 't' || turn || ':' || sha256(coalesce(text, '')))), 1, 12) AS tag FROM conversations GROUP BY 1")
def _(s, d):
    files = read(s, d, "conversations").select(F.col("conv_id").cast("string").alias("dataset"), F.concat(F.lit("t"), F.col("turn").cast("string")).alias("name"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"))
    return dataset_tag(files.withColumn("content_hash", F.col("hash")))


@query("K03_run_manifest", "SELECT count(*) FILTER (WHERE doc_id % 3 = 0) AS created, count(*) FILTER (WHERE doc_id % 3 = 1) AS versioned, count(*) FILTER (WHERE doc_id % 3 = 2) AS unchanged, (SELECT count(*) FROM pages WHERE page_id % 7 = 0) AS failed, 'PARTIALLY_COMPLETED' AS status FROM documents")
def _(s, d):
    names = F.array(*map(F.lit, ("created", "versioned", "unchanged")))
    outcomes = read(s, d, "documents").select(F.element_at(names, (F.col("doc_id") % 3 + 1).cast("int")).alias("outcome"))
    return sinks.run_manifest(outcomes, read(s, d, "pages").filter("page_id % 7 = 0"))


@query("K04_dead_letters", "SELECT event_id, 'not a number' AS error FROM events WHERE event_id % 10 = 0")
def _(s, d):
    parsed = read(s, d, "events").select("event_id", F.when(F.col("event_id") % 10 != 0, F.col("value")).alias("value"))
    return sinks.split_failures(parsed.withColumn("error", F.when(F.col("value").isNull(), "not a number")))[1].select("event_id", "error")


@query("K05_append_events", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'ACQUIRED' ELSE 'MERGED' END AS operation FROM events WHERE event_id % 2 = 0 OR event_id % 5 <> 0")
def _(s, d):
    e = read(s, d, "events").select("event_id")
    old = e.filter("event_id % 2 = 0").withColumn("operation", F.lit("ACQUIRED"))
    new = e.withColumn("operation", F.when(F.col("event_id") % 5 == 0, "made up").otherwise("MERGED"))
    return sinks.append_events(old, new.union(new))
