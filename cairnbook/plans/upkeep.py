"""Registered queries of a store's upkeep: mirrors, redaction as history, gaps, further checks, walks of two steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnbook.functions.lineage import new_folder
from cairnbook.operators import graph, ingest, insight, provenance, secretscan, sinks, validate
from cairnbook.plans import sql
from cairnbook.plans.registry import query
from cairnbook.plans.tables import messages, objects, read, relationships


@query("K02_mirror", f"""WITH {sql.OBJ}, {sql.MSG} SELECT 'messages' AS "table", count(*) AS n_rows, CAST(sum(strlen('{{"object_id":"' || object_id || '","turn":' || turn || '}}') + 1) AS BIGINT) AS bytes FROM msg UNION ALL SELECT 'objects', count(*), CAST(sum(strlen('{{"content_hash":"' || content_hash || '","nothing":null,"object_id":"' || object_id || '"}}') + 1) AS BIGINT) FROM obj""")
def _(s, d):
    """Rows and bytes of a mirror, held against what its files hold."""
    path = new_folder(s, "mirror")
    made = sinks.export_mirror({"objects": objects(s, d).select("object_id", "content_hash", F.lit(None).cast("string").alias("nothing")), "messages": messages(s, d).select("object_id", "turn")}, path)
    held = s.read.text([f"{path}/objects", f"{path}/messages"]).select("value", F.element_at(F.split("_metadata.file_path", "/"), -2).alias("table"))
    held = held.groupBy("table").agg(F.count("*").alias("n_rows"), F.sum(F.octet_length("value") + 1).alias("bytes"))
    return made.join(held, ["table", "n_rows", "bytes"])


_RED = f"r AS (SELECT *, regexp_matches(body, '{sql.TOKEN_ASSIGNMENT}') AS hit, regexp_replace(body, '{sql.TOKEN_ASSIGNMENT}', '[REDACTED:token_assignment]', 'g') AS clean FROM obj)"


def _redacted(s, d):
    o = objects(s, d).select("object_id", F.lit(1).alias("version_num"), "body", F.lit("PRIVATE").alias("classification"))
    indexes = s.createDataFrame([("fts", "FRESH"), ("graph", "FRESH")], "index_name string, status string")
    return secretscan.redact_objects(o, indexes, "2026-01-02")


@query("X03_redacted_objects", f"WITH {sql.OBJ}, {_RED} SELECT object_id, CASE WHEN hit THEN 2 ELSE 1 END AS version_num, clean AS body, CASE WHEN hit THEN 'RESTRICTED' ELSE 'PRIVATE' END AS classification FROM r")
def _(s, d):
    return _redacted(s, d)["objects"]


@query("X03_redaction_history", f"""WITH {sql.OBJ}, {_RED} SELECT object_id || ':v02' AS id, 'corrected' AS kind, clean AS facts FROM r WHERE hit UNION ALL SELECT 'EVT-' || object_id || ':v02', 'MODIFIED', 'redacted: token_assignment' FROM r WHERE hit UNION ALL SELECT n, CASE WHEN (SELECT bool_or(hit) FROM r) THEN 'STALE' ELSE 'FRESH' END, NULL FROM (VALUES ('fts'), ('graph')) v(n)""")
def _(s, d):
    """The corrected versions, the events, and what became of the indexes."""
    made = _redacted(s, d)
    out = made["versions"].select(F.col("version_id").alias("id"), F.col("change_type").alias("kind"), F.col("body").alias("facts"))
    out = out.unionByName(made["events"].select(F.col("event_id").alias("id"), F.col("operation").alias("kind"), F.col("reason").alias("facts")))
    return out.unionByName(made["indexes"].select(F.col("index_name").alias("id"), F.col("status").alias("kind"), F.lit(None).cast("string").alias("facts")))


@query(
    "V09_V12_checks",
    f"""WITH {sql.OBJ}, c AS (SELECT 'conflicts_surfaced' AS "check", (SELECT count(*) FROM events WHERE event_id % 7 = 0) AS violations, 'INFO' AS s UNION ALL SELECT 'no_secret_values_stored', (SELECT count(*) FROM customer WHERE c_custkey % 5 IN (1, 2, 3)), 'ERROR'
UNION ALL SELECT 'no_secret_values_in_bodies', (SELECT count(*) FROM obj WHERE regexp_matches(body, '{sql.TOKEN_ASSIGNMENT}')), 'ERROR' UNION ALL SELECT 'derived_indexes_registered', (SELECT count(*) FROM part WHERE p_partkey % 2 = 0), 'INFO') SELECT "check", violations, CASE WHEN violations = 0 THEN 'OK' ELSE s END AS status FROM c""",
)
def _(s, d):
    conflicts = read(s, d, "events").select(F.when(F.col("event_id") % 7 == 0, "OPEN").otherwise("RESOLVED").alias("status"))
    place = F.when(F.col("c_custkey") % 5 == 1, F.lit("sk-value")).when(F.col("c_custkey") % 5 == 2, F.lit("ghp_value")).when(F.col("c_custkey") % 5 == 3, F.lit("-----BEGIN KEY")).when(F.col("c_custkey") % 5 == 4, F.lit("keychain: sk-")).otherwise("vault/7")
    registry = read(s, d, "customer").select(place.alias("storage_location"))
    o = objects(s, d)
    versions = o.select(F.col("object_id").alias("version_id"), "body")
    indexes = read(s, d, "part").select(F.when(F.col("p_partkey") % 2 == 0, "STALE").otherwise("FRESH").alias("status"))
    out = validate.check(validate.open_conflicts(conflicts), "conflicts_surfaced", "INFO")
    out = out.unionByName(validate.check(validate.values_in_registry(registry), "no_secret_values_stored"))
    out = out.unionByName(validate.check(validate.secrets_in_bodies(o.select("object_id", F.col("object_id").alias("current_version")), versions), "no_secret_values_in_bodies"))
    return out.unionByName(validate.check(validate.stale_indexes(indexes), "derived_indexes_registered", "INFO"))


@query(
    "I01_all_gaps",
    f"""WITH {sql.OBJ}, m AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS k FROM orders WHERE month(o_orderdate) NOT IN (2, 7)), x AS (SELECT unnest(generate_series(min(strptime(k || '-01', '%Y-%m-%d')), max(strptime(k || '-01', '%Y-%m-%d')), INTERVAL 1 MONTH)) AS t FROM m), g AS (
SELECT 'urls_never_fetched' AS gap, (SELECT count(*) FROM pages WHERE page_id % 3 <> 0) AS n, 'high' AS severity UNION ALL SELECT 'files_named_but_never_acquired', (SELECT count(*) FROM obj WHERE doc_id % 6 = 0), 'high' UNION ALL SELECT 'objects_with_no_body_unexpected', (SELECT count(*) FROM obj WHERE doc_id % 9 = 1 AND doc_id % 6 <> 0), 'medium'
UNION ALL SELECT 'content_withheld_for_credentials', (SELECT count(*) FROM obj WHERE doc_id % 10 = 3), 'info' UNION ALL SELECT 'items_in_dead_letter', (SELECT count(*) FROM events WHERE event_id % 10 = 0), 'medium' UNION ALL SELECT 'answers_awaiting_human_review', (SELECT count(*) FROM labels WHERE quality IS NULL OR quality <> 1), 'medium'
UNION ALL SELECT 'open_conflicts', (SELECT count(*) FROM events WHERE event_id % 7 = 0), 'high' UNION ALL SELECT 'sources_never_ingested', (SELECT count(DISTINCT 'src' || s_suppkey) FROM supplier WHERE 'src' || s_suppkey NOT IN (SELECT source FROM documents WHERE source IS NOT NULL)), 'high' UNION ALL SELECT 'ranking_signals_unimplemented', 2, 'info'
UNION ALL SELECT 'months_with_nothing_captured', (SELECT count(*) FROM x WHERE strftime(t, '%Y-%m') NOT IN (SELECT k FROM m)), 'medium') SELECT * FROM g WHERE n > 0""",
)
def _(s, d):
    o = objects(s, d)
    kept = o.select(
        "object_id", F.when(F.col("doc_id") % 6 == 0, "FileReference").when(F.col("doc_id") % 11 == 0, "Answer").otherwise("File").alias("object_class"), F.lit("ORIGINAL").alias("knowledge_state"),
        F.when((F.col("doc_id") % 9 != 1) & (F.col("doc_id") % 6 != 0), F.coalesce(F.nullif("body", F.lit("")), F.lit("text"))).otherwise("").alias("body"), F.when(F.col("doc_id") % 10 == 3, "RESTRICTED").otherwise("PRIVATE").alias("classification"),
    )
    answers = read(s, d, "labels").select(F.concat(F.lit("A"), F.col("doc_id").cast("string")).alias("object_id"), F.lit("Answer").alias("object_class"), F.when(F.col("quality") == 1, "HUMAN_VALIDATED").otherwise("SYNTHESIZED").alias("knowledge_state"), F.lit("answer").alias("body"), F.lit("PRIVATE").alias("classification"))
    e = read(s, d, "events")
    return insight.all_gaps(
        objects=kept.unionByName(answers), urls=read(s, d, "pages").select(F.when(F.col("page_id") % 3 == 0, "FETCHED").otherwise("NOT_FETCHED").alias("fetch_status")), dead_letters=e.filter("event_id % 10 = 0"),
        conflicts=e.select(F.when(F.col("event_id") % 7 == 0, "OPEN").otherwise("RESOLVED").alias("status")), declared=read(s, d, "supplier").select(F.concat(F.lit("src"), F.col("s_suppkey").cast("string")).alias("source_id")), present=o.select("source_id"),
        acquired=read(s, d, "orders").filter(~F.month("o_orderdate").isin(2, 7)).select(F.col("o_orderdate").cast("timestamp").alias("ts")),
    )


@query("L04_top_tags", "SELECT tag, count(*) AS n FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS tag FROM part) WHERE tag <> '' GROUP BY 1 ORDER BY n DESC, tag LIMIT 25")
def _(s, d):
    return insight.top_tags(read(s, d, "part").select(F.split(F.lower("p_name"), " ").alias("tags")))


_HUB = "edge0 AS (SELECT source_object, target_object FROM edge UNION ALL SELECT object_id, 'HUB' FROM msg WHERE (conv_id * 1000 + turn) % 3 = 0)"


@query(
    "Z06_second_degree",
    f"""WITH {sql.EDGE}, {_HUB}, b AS (SELECT source_object AS a, target_object AS b FROM edge0 UNION SELECT target_object, source_object FROM edge0), g AS (SELECT a AS b, count(*) AS degree FROM b GROUP BY 1), k AS (SELECT a, b FROM (SELECT b.a, b.b, row_number() OVER (PARTITION BY b.a ORDER BY degree, b.b) AS r FROM b JOIN g ON b.b = g.b) WHERE r <= 5),
t AS (SELECT x.a, y.b AS c, count(*) AS paths FROM k x JOIN k y ON x.b = y.a WHERE x.a <> y.b GROUP BY 1, 2) SELECT a AS object_id, c AS second, paths FROM t WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.a = t.a AND b.b = t.c)""",
)
def _(s, d):
    """The graph of chats with a hub that every third message meets."""
    m = messages(s, d).filter((F.col("conv_id") * 1000 + F.col("turn")) % 3 == 0).select(F.col("object_id").alias("source_object"), F.lit("HUB").alias("target_object"))
    return graph.second_degree(relationships(s, d).select("source_object", "target_object").unionByName(m), keep=5)


@query(
    "I03_meta",
    f"""WITH {sql.OBJ}, x AS (SELECT *, TIMESTAMP '2020-01-15' + INTERVAL (doc_id % 40) MONTH AS t FROM obj), p AS (
SELECT 'state' AS section, CASE WHEN doc_id % 4 = 0 THEN 'DERIVED' ELSE 'ORIGINAL' END AS k FROM x UNION ALL SELECT 'authority', authority FROM x UNION ALL SELECT 'class', 'File' FROM x UNION ALL SELECT 'decay', 'CURRENT' FROM x
UNION ALL SELECT 'voice', CASE authority WHEN 'PRIMARY SOURCE' THEN 'own words' WHEN 'AI-GENERATED' THEN 'assistant' ELSE 'other' END FROM x UNION ALL SELECT 'provenance', CASE WHEN doc_id % 3 = 0 THEN 'complete' ELSE 'broken' END FROM x
UNION ALL SELECT 'month', strftime(t, '%Y-%m') FROM x UNION ALL SELECT 'year', strftime(t, '%Y') FROM x), g AS (SELECT section, k, count(*) AS n FROM p GROUP BY 1, 2) SELECT section, k AS "key", n, round(100.0 * n / sum(n) OVER (PARTITION BY section), 2) AS percent FROM g""",
)
def _(s, d):
    at = F.add_months(F.lit("2020-01-15").cast("date"), (F.col("doc_id") % 40).cast("int")).cast("timestamp")
    o = objects(s, d).withColumns({"created_at": at, "knowledge_state": F.when(F.col("doc_id") % 4 == 0, "DERIVED").otherwise("ORIGINAL")})
    return insight.meta(o, o.filter("doc_id % 3 <> 2").select("object_id", (F.col("doc_id") % 3 == 0).alias("complete")))


@query(
    "Q03_coverage",
    f"""WITH {sql.OBJ}, x AS (SELECT *, TIMESTAMP '2020-01-15' + INTERVAL (doc_id % 40) MONTH AS t FROM obj), h AS (SELECT source_id, count(*) AS n, min(t) AS a, max(t) AS b, count(*) FILTER (WHERE doc_id % 10 = 3) AS r FROM x GROUP BY 1), w AS (SELECT DISTINCT 'src' || s_suppkey AS source_id FROM supplier),
l AS (SELECT 'src' || (event_id % 30) AS source_id, count(*) AS n FROM events WHERE event_id % 10 = 0 GROUP BY 1), u AS (SELECT 'src' || (page_id % 4) AS source_id, count(*) AS n FROM pages GROUP BY 1), k AS (SELECT source_id FROM h UNION SELECT source_id FROM w UNION SELECT source_id FROM l UNION SELECT source_id FROM u)
SELECT source_id, h.n IS NOT NULL AS present, coalesce(h.n, 0) AS n, a AS "first", b AS "last", coalesce(r, 0) AS redacted, coalesce(l.n, 0) AS dead_letters, coalesce(u.n, 0) AS urls FROM k LEFT JOIN h USING (source_id) LEFT JOIN l USING (source_id) LEFT JOIN u USING (source_id)""",
)
def _(s, d):
    at = F.add_months(F.lit("2020-01-15").cast("date"), (F.col("doc_id") % 40).cast("int")).cast("timestamp_ntz")
    o = objects(s, d).withColumns({"created_at": at, "classification": F.when(F.col("doc_id") % 10 == 3, "RESTRICTED").otherwise("PRIVATE")})
    source = lambda c: F.concat(F.lit("src"), c.cast("string")).alias("source_id")
    return provenance.coverage(o, read(s, d, "supplier").select(source(F.col("s_suppkey"))), read(s, d, "events").filter("event_id % 10 = 0").select(source(F.col("event_id") % 30)), read(s, d, "pages").select(source(F.col("page_id") % 4)))


@query("Z07_server_runs", """WITH r AS (SELECT c_nationkey AS host, c_custkey AS run, list_sort([c_mktsegment, 'base']) AS now FROM customer), l AS (SELECT *, lag(now) OVER (PARTITION BY host ORDER BY run) AS was FROM r)
SELECT host, run, CASE WHEN was IS NOT NULL THEN array_to_string(list_sort(list_filter(now, lambda x: NOT list_contains(was, x))), ',') END AS came, CASE WHEN was IS NOT NULL THEN array_to_string(list_sort(list_filter(was, lambda x: NOT list_contains(now, x))), ',') END AS went, CASE WHEN run % 2 = 0 THEN 'v' || run ELSE '' END AS orphans FROM l""")
def _(s, d):
    volume = F.concat(F.lit("v"), F.col("c_custkey").cast("string"))
    runs = read(s, d, "customer").select(F.col("c_nationkey").alias("host"), F.col("c_custkey").alias("run"), F.array("c_mktsegment", F.lit("base")).alias("containers"), F.array(volume, F.lit("data")).alias("volumes"), F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("data"))).otherwise(F.array(F.lit("data"), volume)).alias("mounted"))
    out = insight.compare_servers(runs)
    return out.select("host", "run", F.array_join("came", ",").alias("came"), F.array_join("went", ",").alias("went"), F.array_join("orphan_volumes", ",").alias("orphans"))


@query("T01_stream_ingest", f"WITH {sql.OBJ} SELECT native_id, content_hash, CASE WHEN doc_id % 10 = 0 THEN 2 ELSE 1 END AS version_num FROM (SELECT doc_id, 'doc' || doc_id AS native_id, CASE WHEN doc_id % 10 = 0 THEN sha256(content_hash) ELSE content_hash END AS content_hash FROM obj)")
def _(s, d):
    """Two files of items, the second with changed and old ones, fed by a stream that is started twice."""
    folder, path, checkpoint = (new_folder(s, f"stream-{n}") for n in ("in", "store", "checkpoint"))
    items = objects(s, d).select("source_id", "account_id", F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("native_id"), "content_hash", "doc_id")
    changed = items.withColumn("content_hash", F.when(F.col("doc_id") % 10 == 0, F.sha2("content_hash", 256)).otherwise(F.col("content_hash")))
    for rows in (items, changed):
        rows.write.mode("append").parquet(folder)
        live = s.readStream.schema(items.schema).parquet(folder)
        ingest.ingest_stream(live, path, checkpoint, "2026-01-01", lambda df: df).awaitTermination()
    return ingest.read_table(s, path, "source_object").select("native_id", "content_hash", "version_num")
