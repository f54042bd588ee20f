"""Registered scans of documents whose schema isn't known, or whose parts are of many kinds. The exports are put together
from the tables inside each query; the SQL says what must come out."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnbook.functions import text as tx
from cairnbook.operators import nested
from cairnbook.plans.registry import query
from cairnbook.plans.tables import read
from cairnbook.sources import assistant, declared, files, markup, records

#: A workflow's parameters from a document's number and hash, five levels deep, in words that Spark and DuckDB share.
_PARAMS = """concat('{"a":{"b":[{"c":{"deep":"v', doc_id, '","password":"p', h, '"}},["x",{"Api_Key":[1,2]}]]},"auth":{"clientSecret":{"id":1},"user":"u', doc_id, '"},"empty":[{},[]],"n":', doc_id, ',"note":"', CASE WHEN doc_id % 3 = 0 THEN concat('ghp_', substr(h, 1, 36)) ELSE 'plain' END, '","z":null}')"""
_CLEAN = """concat('{"a":{"b":[{"c":{"deep":"v', doc_id, '","password":"[REDACTED: key]"}},["x",{"Api_Key":"[REDACTED: key]"}]]},"auth":{"clientSecret":"[REDACTED: key]","user":"u', doc_id, '"},"empty":[{},[]],"n":', doc_id, ',"note":"', CASE WHEN doc_id % 3 = 0 THEN '[REDACTED: value]' ELSE 'plain' END, '","z":null}')"""
_HASHED = "(SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents)"


def _params(s, d):
    return read(s, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h")).select(F.col("doc_id").alias("id"), F.expr(_PARAMS).alias("params"))


@query("X05_nested_parameters", f"SELECT doc_id AS id, {_CLEAN} AS params FROM {_HASHED}")
def _(s, d):
    return nested.redact_nested(_params(s, d))[0]


@query("X05_redacted_paths", f"SELECT doc_id AS id, unnest(['$.a.b[0].c.password', '$.a.b[1][1].Api_Key', '$.auth.clientSecret']) AS path, 'key' AS reason FROM {_HASHED} UNION ALL SELECT doc_id, '$.note', 'github_token' FROM {_HASHED} WHERE doc_id % 3 = 0")
def _(s, d):
    return nested.redact_nested(_params(s, d))[1]


@query("S35_refused_exports", "SELECT 'wf/' || s_suppkey || '.json' AS path FROM supplier WHERE s_suppkey % 4 = 0")
def _(s, d):
    text = F.when(F.col("s_suppkey") % 4 == 0, F.lit('[{"oauthTokenData":1}]')).otherwise(F.lit('{"nodes":[]}'))
    return nested.refused_exports(read(s, d, "supplier").select(F.concat(F.lit("wf/"), F.col("s_suppkey").cast("string"), F.lit(".json")).alias("path"), text.alias("text")))[1]


#: A turn as a record of one of three layouts, and a decoy list that is shorter.
_KEY = lambda: F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))


@query(
    "S32_social_records",
    """WITH m AS (SELECT conv_id, turn, conv_id % 3 AS layout, conv_id || '-' || turn AS k, 1600000000 + conv_id * 100 + turn AS t FROM conversations)
SELECT 'posts/' || conv_id || '.json' AS native_path, CASE layout WHEN 0 THEN 'post ' || k || chr(10) || 'pic ' || k WHEN 1 THEN 'Name: ' || k || chr(10) || 'Note: same' ELSE 'only ' || k END AS body, strftime(to_timestamp(t) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS created FROM m""",
)
def _(s, d):
    key = _KEY()
    t = (F.lit(1_600_000_000) + F.col("conv_id") * 100 + F.col("turn")).cast("string")
    put = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    first = put('{"timestamp":', t, ',"title":"post ', key, '","media":[{"title":"pic ', key, '"},{"title":"post ', key, '"}],"data":[{"post":"pic ', key, '"},{"x":1}]}')
    second = put('{"string_map_data":{"Name":{"value":"', key, '","timestamp":', t, '},"Note":{"value":"same"},"Void":{"value":""}}}')
    third = put('{"title":"","description":"only ', key, '","media":[{"uri":"u","creation_timestamp":', t, '}]}')
    record = F.when(F.col("conv_id") % 3 == 0, first).when(F.col("conv_id") % 3 == 1, second).otherwise(third)
    files = read(s, d, "conversations").groupBy("conv_id").agg(F.array_join(F.collect_list(record), ",").alias("r"))
    text = F.when(F.col("conv_id") % 3 == 0, put("[", F.col("r"), ',"noise"]')).otherwise(put('{"about":"x","few":[],"mixed":[1,{"a":1},2,3,4,5,6,7,8,9,10,11,12,13,14,15,16,17,18,19,20],"records":[', F.col("r"), "]}"))
    thread = files.select(put("threads/", F.col("conv_id").cast("string"), ".json").alias("path"), F.lit('{"participants":[],"messages":[{"content":"no record"}]}').alias("text"))
    posts = files.select(put("posts/", F.col("conv_id").cast("string"), ".json").alias("path"), text.alias("text"))
    found = records.scan_social_records(posts.unionByName(thread), "social")
    return found.select("native_path", "body", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created"))


@query(
    "S23_content_blocks",
    """SELECT conv_id, turn, text || chr(10) || chr(10) || '[assistant reasoning]' || chr(10) || 'think ' || turn || chr(10) || chr(10) || '[tool_use: search' || CASE WHEN turn % 2 = 1 THEN ' via Drive' ELSE '' END || '] {"q":"' || repeat('x', 394) || chr(10) || chr(10)
|| '[tool_result: tool' || CASE WHEN turn % 5 = 0 THEN ' ERROR' ELSE '' END || ', 9 chars - full payload in evidence]' || chr(10) || chr(10) || '[flag block]' || CASE turn % 3 WHEN 1 THEN chr(10) || chr(10) || '[export top-level text]' || chr(10) || 'other ' || turn ELSE '' END AS body FROM conversations""",
)
def _(s, d):
    fields = ["type", "text", "thinking", "name", "integration_name", "input", "content", "is_error"]
    block = lambda **x: F.struct(*[x.get(f, F.lit(None)).cast("boolean" if f == "is_error" else "string").alias(f) for f in fields])
    turn = F.col("turn")
    content = F.array(
        block(type=F.lit("text"), text=F.col("text")), block(type=F.lit("text"), text=F.lit("")), block(type=F.lit("thinking"), thinking=F.concat(F.lit("think "), turn.cast("string"))),
        block(type=F.lit("tool_use"), name=F.lit("search"), integration_name=F.when(turn % 2 == 1, "Drive"), input=F.concat(F.lit('{"q":"'), F.repeat(F.lit("x"), 500), F.lit('"}'))),
        block(type=F.lit("token_budget")), block(type=F.lit("tool_result"), content=F.lit('["a","b"]'), is_error=turn % 5 == 0), block(type=F.lit("flag")),
    )
    top = F.when(turn % 3 == 0, F.concat(F.lit(" \n"), F.replace("text", F.lit(" "), F.lit("  ")))).when(turn % 3 == 1, F.concat(F.lit("other "), turn.cast("string")))
    return read(s, d, "conversations").select("conv_id", "turn", records.render_blocks(content, top).alias("body"))


# assistant exports, from documents, customers and events


@query(
    "S24_attachments",
    """SELECT 'attachment:m' || doc_id || ':' || i AS native_id, 'Attachment' AS object_class, CASE i WHEN 0 THEN source || '.txt' ELSE '(unnamed attachment 1)' END AS title, CASE i WHEN 0 THEN text END AS body, 'message:m' || doc_id AS target FROM documents, (VALUES (0), (1)) v(i)
UNION ALL SELECT 'file_ref:f' || doc_id, 'FileReference', '(uploaded file, bytes not exported)', NULL, 'message:m' || doc_id FROM documents""",
)
def _(s, d):
    name = F.concat("source", F.lit(".txt"))
    text = lambda c=None: F.lit(None).cast("string") if c is None else c
    one = lambda n, b: F.struct(n.alias("file_name"), b.alias("extracted_content"), F.lit("txt").alias("file_type"))
    number = F.col("doc_id").cast("string")
    message = F.struct(F.concat(F.lit("m"), number).alias("uuid"), F.lit("2026-01-01T00:00:00Z").alias("created_at"), F.array(one(name, F.col("text")), one(text(), text())).alias("attachments"), F.array(F.struct(F.concat(F.lit("f"), number).alias("file_uuid"), text().alias("file_name"))).alias("files"))
    items, edges = assistant.scan_attachments(read(s, d, "documents").select(F.array(message).alias("chat_messages")))
    return items.join(edges.select(F.col("source_native").alias("native_id"), F.col("target_native").alias("target")), "native_id").select("native_id", "object_class", "title", "body", "target")


@query(
    "S25_projects",
    """SELECT 'project:' || c_custkey AS native_id, 'Project' AS object_class, c_name AS title, CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN c_mktsegment ELSE c_mktsegment || chr(10) || chr(10) || 'Custom instructions:' || chr(10) || 'be ' || c_mktsegment END AS body, NULL AS part_of FROM customer
UNION ALL SELECT 'project_doc:d' || c_custkey, 'ProjectDocument', 'notes.md', c_name, 'project:' || c_custkey FROM customer WHERE c_custkey % 2 = 0""",
)
def _(s, d):
    c = read(s, d, "customer")
    key = F.col("c_custkey").cast("string")
    docs = F.array(F.struct(F.concat(F.lit("d"), key).alias("uuid"), F.lit("notes.md").alias("filename"), F.col("c_name").alias("content"), F.lit(None).cast("string").alias("created_at")))
    p = c.select(key.alias("uuid"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment")).otherwise("").alias("description"), F.when(F.col("c_custkey") % 3 == 2, F.concat(F.lit("be "), "c_mktsegment")).alias("prompt_template"), F.lit(True).alias("is_private"), F.lit(None).cast("string").alias("created_at"), F.lit(None).cast("string").alias("updated_at"), F.when(F.col("c_custkey") % 2 == 0, docs).alias("docs"))
    items, edges, _ = assistant.scan_projects(p)
    return items.join(edges.select(F.col("source_native").alias("native_id"), F.col("target_native").alias("part_of")), "native_id", "left").select("native_id", "object_class", "title", "body", "part_of")


_ACCOUNT = "0a1b2c3d-0000-4000-8000-00000000000a"


@query(
    "S26_assistant_memory",
    """SELECT 'memory:story:0' AS native_id, 'of ' || count(*) AS body FROM supplier UNION ALL SELECT 'memory:projects/p' || s_suppkey || ':0', s_name FROM supplier UNION ALL SELECT 'memory:projects/q' || s_suppkey || ':0', '{"n":' || s_suppkey || '}' FROM supplier
UNION ALL SELECT 'memory_file:/m/' || s_suppkey, 'file of ' || s_name FROM supplier UNION ALL SELECT 'foreign', '1'""",
)
def _(s, d):
    sup = read(s, d, "supplier")
    put = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    key = F.col("s_suppkey").cast("string")
    slots = F.array_join(F.collect_list(put('"p', key, '":"', F.col("s_name"), '","q', key, '":{"n":', key, '},"z', key, '":""')), ",")
    docs = F.array_join(F.collect_list(put('{"path":"/m/', key, '","content":"file of ', F.col("s_name"), '","updated_at":"2026-01-01T00:00:00Z"}')), ",")
    own = sup.agg(F.count("*").cast("string").alias("n"), slots.alias("slots"), docs.alias("docs")).select(put("memories/", _ACCOUNT, ".json").alias("path"), put('[{"account_uuid":"x","story":"of ', F.col("n"), '","void":"","projects":{', F.col("slots"), '},"memory_files":[', F.col("docs"), "]}]").alias("text"))
    other = own.select(F.lit("memories/ffffffff-0000-4000-8000-00000000000b.json").alias("path"), F.lit('{"story":"not ours"}').alias("text"))
    items, foreign = assistant.scan_memory(own.unionByName(other), _ACCOUNT)
    return items.select("native_id", "body").unionByName(foreign.agg(F.count("*").cast("string").alias("body")).select(F.lit("foreign").alias("native_id"), "body"))


@query(
    "S27_logins",
    r"""WITH e AS (SELECT event_id, user_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS t, event_type FROM events)
SELECT 'login:' || t AS native_id, 'Sign-in ' || substr(t, 1, 19) || ' from ' || CASE WHEN user_id % 2 = 0 THEN 'Town, Land' ELSE 'unknown location' END AS title, concat_ws(chr(10), 'Sign-in', 'when   : ' || t, 'method : ' || event_type, 'from   : unknown ip (' || CASE WHEN user_id % 2 = 0 THEN 'Town, Land' ELSE 'unknown location' END || ')', 'device : Browser on OS 1') AS body FROM e WHERE user_id % 7 <> 0""",
)
def _(s, d):
    e = read(s, d, "events").withColumn("even", F.col("user_id") % 2 == 0)
    none = F.lit(None).cast("string")
    rows = e.select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), F.col("event_type").alias("method"), none.alias("ip_address"), F.when(F.col("user_id") % 7 == 0, "other").when(F.col("user_id") % 5 == 0, none).otherwise(_ACCOUNT).alias("account_uuid"),
        F.struct(F.lit("Browser").alias("browser_family"), F.lit("").alias("browser_version"), F.lit("OS").alias("os_family"), F.lit("1").alias("os_version")).alias("user_agent"),
        F.struct(F.when(F.col("even"), "Town").alias("city"), none.alias("region"), F.when(F.col("even"), "Land").alias("country")).alias("location_info"),
    )
    return assistant.scan_logins(rows, _ACCOUNT)[0].select("native_id", "title", "body")


@query("S07_drive_files", "SELECT 'drive:Drive/' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.txt' ELSE '.docx' END AS native_id, CASE doc_id % 3 WHEN 0 THEN 'Title ' || doc_id ELSE doc_id || '.docx' END AS title, CASE doc_id % 3 WHEN 0 THEN text END AS body, CASE doc_id % 3 WHEN 0 THEN 'https://x/' || doc_id END AS native_url FROM documents")
def _(s, d):
    docs = read(s, d, "documents")
    end = F.when(F.col("doc_id") % 3 == 0, ".txt").otherwise(".docx")
    path = F.concat(F.lit("Drive/"), F.col("doc_id").cast("string"), end)
    files = docs.select(path.alias("path"), F.sha2("text", 256).alias("content_hash"), F.col("n_chars").alias("length"), "text")
    told = docs.filter("doc_id % 3 = 0").select(F.concat(path, F.when(F.col("doc_id") % 2 == 0, "-info.json").otherwise("-metadata.json")).alias("path"), F.concat(F.lit("Title "), F.col("doc_id").cast("string")).alias("title"), F.concat(F.lit("https://x/"), F.col("doc_id").cast("string")).alias("url"), F.lit(None).cast("string").alias("created_date"), F.lit(None).cast("string").alias("modified_date"))
    beside = told.select("path", F.lit("h").alias("content_hash"), F.lit(1).cast("long").alias("length"), F.lit("{}").alias("text"))
    return assistant.scan_drive(files.unionByName(beside), told).select("native_id", "title", "body", "native_url")


@query("S11_mail_archives", "SELECT 'mail_archive:Mail/' || c_custkey || '.mbox' AS native_id, sha256(c_name) AS content_hash, '{\"bytes\":' || c_custkey || ',\"interpreted\":false}' AS raw_metadata FROM customer WHERE c_custkey % 4 = 0")
def _(s, d):
    name = F.concat(F.lit("Mail/"), F.col("c_custkey").cast("string"), F.when(F.col("c_custkey") % 4 == 0, ".mbox").otherwise(".eml"))
    files = read(s, d, "customer").select(name.alias("path"), F.sha2("c_name", 256).alias("content_hash"), F.col("c_custkey").cast("long").alias("length"))
    return assistant.declare_mail_archives(files).select("native_id", "content_hash", "raw_metadata")


@query("S18_databases", """SELECT 'database:db/' || o_custkey || '.csv' AS native_id, '{"row_count":' || count(*) || ',"columns":["key","na,me","note"]}' AS raw_metadata FROM orders GROUP BY o_custkey""")
def _(s, d):
    row = F.concat(F.col("o_orderkey").cast("string"), F.lit(',"a\n""b""\n c",'), "o_orderstatus")
    files = read(s, d, "orders").groupBy("o_custkey").agg(F.array_join(F.collect_list(row), "\n").alias("rows"))
    text = F.concat(F.lit('key,"na,me",note\n'), "rows", F.lit("\n"))
    return assistant.scan_databases(files.select(F.concat(F.lit("db/"), F.col("o_custkey").cast("string"), F.lit(".csv")).alias("path"), text.alias("text"))).select("native_id", "raw_metadata")


@query("F29_link_ids", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE substr(sha256(text), 1, 32) END AS id FROM documents")
def _(s, d):
    h = F.substring(F.sha2("text", 256), 1, 32)
    name = F.when(F.col("doc_id") % 4 == 0, "My%20page%2031.html").when(F.col("doc_id") % 4 == 1, F.concat(F.lit("My%20page%20"), h, F.lit(".html"))).when(F.col("doc_id") % 4 == 2, F.concat(F.lit("../x/"), F.upper(h), F.lit("?v=1"))).otherwise(F.concat(F.lit("100%25"), h))
    return read(s, d, "documents").select("doc_id", tx.link_id(name).alias("id"))


@query("F30_flat_values", """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_custkey || ', a, b, x' WHEN 1 THEN c_mktsegment WHEN 2 THEN '{"k":' || c_custkey || '}' ELSE c_custkey::VARCHAR END AS value FROM customer""")
def _(s, d):
    put = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    key = F.col("c_custkey").cast("string")
    v = F.when(F.col("c_custkey") % 4 == 0, put("[", key, ',["a",{"filename":"b"}],"x"]')).when(F.col("c_custkey") % 4 == 1, put('{"name":"', F.col("c_mktsegment"), '","email":"e"}')).when(F.col("c_custkey") % 4 == 2, put('{"k":', key, "}")).otherwise(key)
    return read(s, d, "customer").select("c_custkey", F.parse_json(v).alias("v")).select("c_custkey", tx.flat_value(F.col("v")).alias("value"))


# mail threads, from conversations: every turn answers the one before


def _mail(s, d):
    c = read(s, d, "conversations")
    name = lambda t: F.concat(F.lit("<"), F.concat_ws(".", F.col("conv_id").cast("string"), t.cast("string")), F.lit("@x.example>"))
    t = F.col("turn")
    me, them = F.lit("Me <me@home.example>"), F.lit("them@x.example")
    head = F.concat(
        F.lit("From: "), F.when(t % 2 == 0, me).otherwise(them), F.lit("\nTo: "), F.when(t % 2 == 0, them).otherwise(me), F.lit("\nSubject: =?utf-8?b?"), F.base64(F.concat(F.lit("Tür "), F.col("conv_id").cast("string")).cast("binary")), F.lit("?=\nDate: Mon, 01 Jan 2024 10:00:00 +0100\nMessage-ID: "), name(t), F.lit("\n"),
        F.when(t > 0, F.concat(F.lit("In-Reply-To: "), name(t - 1), F.lit("\nReferences: "), name(F.lit(0)), F.lit(" "), name(t - 1), F.lit("\n"))).otherwise(""), F.when(F.col("conv_id") % 2 == 0, F.lit("List-Id: <list.x.example>\n")).otherwise(""),
    )
    stub = F.lit("--b\nContent-Type: text/plain\n\nPlease enable HTML to read this much longer and quite friendly message\n--b\nContent-Type: text/html\n\n<p>turn ")
    body = F.concat(F.lit('MIME-Version: 1.0\nContent-Type: multipart/mixed; boundary=b\n\n'), stub, t.cast("string"), F.lit('</p>\n--b\nContent-Type: application/pdf\nContent-Disposition: attachment; filename="f.pdf"\nContent-Transfer-Encoding: base64\n\n'), F.base64(F.col("role").cast("binary")), F.lit("\n--b--\n"))
    parsed = markup.parse_messages(c.select(F.lit("box").alias("mailbox"), F.concat(head, body).alias("raw")))
    return markup.scan_mail(parsed, s.createDataFrame([("box", "ME@home.example")], "mailbox string, identity string"))


_ID = "'msg:<' || conv_id || '.' || turn || '@x.example>'"


@query(
    "S12_mail_threads",
    f"""SELECT {_ID} AS native_id, 'Tür ' || conv_id AS title, 'turn ' || turn AS body, CASE WHEN turn % 2 = 0 THEN 'sent' ELSE 'received' END AS direction, CASE WHEN conv_id % 2 = 0 THEN '<list.x.example>' END AS list_id, CASE WHEN turn > 0 THEN '<' || conv_id || '.0@x.example> <' || conv_id || '.' || (turn - 1) || '@x.example>' END AS "references", TIMESTAMP '2024-01-01 09:00:00' AS created_at,
CASE WHEN turn > 0 THEN 'msg:<' || conv_id || '.' || (turn - 1) || '@x.example>' END AS replies_to FROM conversations""",
)
def _(s, d):
    items, edges, _ = _mail(s, d)
    facts = F.from_json("raw_metadata", "direction string, list_id string, references array<string>")
    met = items.join(edges.select(F.col("source_native").alias("native_id"), F.col("target_native").alias("replies_to")), "native_id", "left").withColumn("f", facts)
    return met.select("native_id", "title", "body", "f.direction", "f.list_id", F.array_join("f.references", " ").alias("references"), F.col("created_at").cast("timestamp_ntz").alias("created_at"), "replies_to")


@query("S16_mail_attachments", f"SELECT {_ID} AS native_id, 'f.pdf' AS name, 'application/pdf' AS mime, strlen(role) AS bytes, sha256(role) AS content_hash FROM conversations")
def _(s, d):
    return _mail(s, d)[2].select("native_id", "name", "mime", "bytes", "content_hash")


# calendars, canvases, note links


@query("Z05_calendar_events", "SELECT 'cal/' || o_custkey || '.ics' AS path, 'u' || o_orderkey AS uid, 'Order, ' || o_orderstatus || chr(10) || 'long' AS summary, strftime(o_orderdate, '%Y%m%d') AS starts FROM orders")
def _(s, d):
    put = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    event = put("BEGIN:VEVENT\r\nUID:u", F.col("o_orderkey").cast("string"), "\r\nSUMMARY;LANGUAGE=en:Order\\, ", F.col("o_orderstatus"), "\\nlo\r\n ng\r\nDTSTART;VALUE=DATE:", F.date_format("o_orderdate", "yyyyMMdd"), "\r\nEND:VEVENT\r\n")
    files = read(s, d, "orders").groupBy("o_custkey").agg(F.array_join(F.collect_list(event), "").alias("e"))
    return records.calendar_events(files.select(put("cal/", F.col("o_custkey").cast("string"), ".ics").alias("path"), put("BEGIN:VCALENDAR\r\n", F.col("e"), "END:VCALENDAR").alias("text"))).select("path", "uid", "summary", "starts")


@query("Z05_canvas", "SELECT conv_id || '.canvas' AS path, 'n' || turn AS node, CASE turn % 2 WHEN 0 THEN 'text' ELSE 'file' END AS kind, text, CASE WHEN turn > 0 THEN 'n' || (turn - 1) END AS source FROM conversations")
def _(s, d):
    name = lambda t: F.concat(F.lit("n"), t.cast("string"))
    text = F.lit(None).cast("string")
    even = F.col("turn") % 2 == 0
    node = F.struct(name(F.col("turn")).alias("id"), F.when(even, "text").otherwise("file").alias("type"), F.when(even, F.col("text")).otherwise(text).alias("text"), F.when(~even, F.col("text")).alias("file"))
    edge = F.when(F.col("turn") > 0, F.struct(name(F.col("turn") - 1).alias("fromNode"), name(F.col("turn")).alias("toNode")))
    files = read(s, d, "conversations").groupBy("conv_id").agg(F.to_json(F.struct(F.collect_list(node).alias("nodes"), F.collect_list(edge).alias("edges"))).alias("text"))
    nodes, edges = records.scan_canvas(files.select(F.concat(F.col("conv_id").cast("string"), F.lit(".canvas")).alias("path"), "text"))
    return nodes.join(edges.select("path", F.col("target").alias("node"), "source"), ["path", "node"], "left").select("path", "node", "kind", "text", "source")


@query(
    "S17_note_edges",
    """WITH p AS (SELECT doc_id, substr(sha256(doc_id::VARCHAR), 1, 32) AS id FROM documents) SELECT a.id AS source_native, b.id AS target_native, 'LINKS_TO' AS type FROM p a JOIN p b ON b.doc_id = a.doc_id // 2 AND a.doc_id > 0
UNION ALL SELECT a.id, b.id, 'PART_OF' FROM p a JOIN p b ON b.doc_id = a.doc_id // 10 AND a.doc_id > 0""",
)
def _(s, d):
    id_ = lambda c: F.substring(F.sha2(c.cast("string"), 256), 1, 32)
    k = F.col("doc_id")
    folder = F.concat(F.lit("Export/Page "), id_(F.floor(k / 10)), F.lit("/"))
    path = F.concat(F.when(k > 0, folder).otherwise("Export/"), F.lit("Page "), id_(k), F.lit(".md"))
    body = F.concat(F.lit("see [that](Page%20"), id_(F.floor(k / 2)), F.lit(".md) and [none](https://x.example/a) and [gone](Page%20"), F.lit("0" * 32), F.lit(".md)"))
    export = files.scan_notes_export(read(s, d, "documents").select(path.alias("path"), F.lit("2026-01-01").cast("timestamp").alias("modified_at"), body.cast("binary").alias("content")))
    links, part = files.notes_export_edges(export)
    return links.unionByName(part)


@query("S19_star_visits", "SELECT 'https://git.example/' || c_custkey AS url, CASE WHEN c_custkey % 2 = 0 THEN TIMESTAMP '2024-05-01 10:00:00' END AS ts, 'o/' || c_custkey AS title FROM customer")
def _(s, d):
    key = F.col("c_custkey").cast("string")
    fields = [F.concat(F.lit("o/"), key).alias("full_name"), F.concat(F.lit("https://git.example/"), key).alias("html_url"), F.lit("d").alias("description"), F.lit("l").alias("language"), F.array(F.lit("t")).alias("topics")]
    c = read(s, d, "customer")
    dated = c.filter("c_custkey % 2 = 0").select(F.lit("2024-05-01T10:00:00Z").alias("starred_at"), F.struct(*fields).alias("repo"))
    rows = dated.unionByName(records.undated_stars(c.filter("c_custkey % 2 = 1").select(*fields)))
    return records.star_visits(rows).select("url", F.col("ts").cast("timestamp_ntz").alias("ts"), "title")


@query(
    "S31_declared_files",
    """SELECT 'linkedin:connections:' || substr(sha256('First Name=' || c_name || '|Company=' || c_mktsegment), 1, 24) AS native_id, 'Contact' AS object_class, c_name AS title, TIMESTAMP '2024-03-15 00:00:00' AS created_at FROM customer
UNION ALL SELECT 'linkedin:my_sales_2:' || substr(sha256('Order Number=' || o_orderkey || '|Purchase Date=2024-01-02'), 1, 24), 'Sale', o_orderstatus, TIMESTAMP '2024-01-02 00:00:00' FROM orders WHERE o_orderkey % 5 = 0
UNION ALL SELECT 'linkedin:odd:' || substr(sha256('A=' || s_suppkey || '|B=' || s_name), 1, 24), 'TabularRecord', s_name, NULL FROM supplier""",
)
def _(s, d):
    cell = lambda *kv: F.map_from_arrays(F.array(*map(F.lit, kv[::2])), F.array(*[x.cast("string") for x in kv[1::2]]))
    one = read(s, d, "customer").select(F.lit("x/Connections.csv").alias("path"), cell("Company", F.col("c_mktsegment"), "First Name", F.concat(F.lit(" "), "c_name"), "URL", F.lit(""), "Connected On", F.lit("15 Mar 2024")).alias("row"))
    two = read(s, d, "orders").filter("o_orderkey % 5 = 0").select(F.lit("x/My Sales-2.csv").alias("path"), cell("Item Name", F.lit(None), "Purchase Date", F.lit("2024-01-02"), "Order Number", F.col("o_orderkey"), "Buyer Name", F.col("o_orderstatus")).alias("row"))
    three = read(s, d, "supplier").select(F.lit("x/odd.csv").alias("path"), cell("B", F.col("s_name"), "A", F.col("s_suppkey")).alias("row"))
    items = declared.scan_declared(one.unionByName(two).unionByName(three), "linkedin", "me")[0]
    return items.select("native_id", "object_class", "title", F.col("created_at").cast("timestamp_ntz").alias("created_at"))
