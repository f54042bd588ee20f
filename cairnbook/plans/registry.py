"""The registered queries over the knowledge store, and their DuckDB SQL.

Keys start with the id of the operator in the survey's inventory. Each query is a thin plan over an operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairnbook.functions import text as tx
from cairnbook.functions.times import chrome_ts, from_epoch, month
from cairnbook.functions.urls import canonicalize_url, registrable_domain
from cairnbook.operators import canonical, dedupe, graph, insight, provenance, replication, search, secretscan, validate
from cairnbook.plans import sql
from cairnbook.plans.tables import messages, objects, read, relationships, urls, visits
from cairnbook.streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "R07_all_signals"


def query(name: str, oracle: str | None = None):
    def add(f):
        if name in QUERIES:
            raise ValueError(f"{name} is registered already")
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return add


# projections, filters, predicates


@query("P01_projection", f"WITH {sql.OBJ} SELECT object_id, source_id AS src, bytes AS size FROM obj")
def _(s, d):
    return objects(s, d).select("object_id", F.col("source_id").alias("src"), F.col("bytes").alias("size"))


@query("P02_range_filter", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_shipdate >= TIMESTAMP '1996-01-01'")
def _(s, d):
    return read(s, d, "lineitem").filter((F.col("l_quantity") > 45) & (F.col("l_shipdate") >= F.lit("1996-01-01").cast("timestamp_ntz"))).select("l_orderkey", "l_linenumber", "l_quantity")


@query("P03_null_safe_equality", "SELECT count(*) AS n FROM (SELECT NULLIF(c_mktsegment, 'BUILDING') AS k FROM customer) WHERE k IS NOT DISTINCT FROM NULL")
def _(s, d):
    k = F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment"))
    return read(s, d, "customer").filter(k.eqNullSafe(F.lit(None))).agg(F.count("*").alias("n"))


@query("P04_null_and_empty", "SELECT count(*) AS n, count(*) FILTER (WHERE text IS NULL) AS n_null, count(*) FILTER (WHERE text = '') AS n_empty FROM documents")
def _(s, d):
    return read(s, d, "documents").agg(F.count("*").alias("n"), F.count_if(F.col("text").isNull()).alias("n_null"), F.count_if(F.col("text") == "").alias("n_empty"))


@query("P05_in_list", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderpriority NOT IN ('1-URGENT', '2-HIGH')")
def _(s, d):
    return read(s, d, "orders").filter(F.col("o_orderstatus").isin("F", "P") & ~F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey", "o_orderstatus")


@query("P06_like", "SELECT page_id, url FROM pages WHERE url ILIKE '%EXAMPLE.ORG%' OR url LIKE 'http://%'")
def _(s, d):
    return read(s, d, "pages").filter(F.col("url").ilike("%EXAMPLE.ORG%") | F.col("url").like("http://%")).select("page_id", "url")


@query("P07_whole_word", "SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^a-z0-9])token([^a-z0-9]|$)')")
def _(s, d):
    return read(s, d, "documents").filter(F.lower("text").rlike("(^|[^a-z0-9])token([^a-z0-9]|$)")).select("doc_id")


@query("P08_exists", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000) AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')")
def _(s, d):
    c, o = read(s, d, "customer"), read(s, d, "orders")
    rich = o.filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    open_ = o.filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(rich, "c_custkey", "left_semi").join(open_, "c_custkey", "left_anti").select("c_custkey")


@query("P09_match_all_terms", f"WITH {sql.TOKENS}, q AS (SELECT DISTINCT item_id, t FROM (SELECT item_id, unnest({sql.toks('text')}) AS t FROM benchmark)), n AS (SELECT item_id, count(*) AS k FROM q GROUP BY 1), h AS (SELECT q.item_id, w.doc_id, count(DISTINCT q.t) AS k FROM q JOIN (SELECT DISTINCT doc_id, t FROM tok) w ON q.t = w.t GROUP BY 1, 2) SELECT h.item_id, count(*) AS n_docs FROM h JOIN n ON h.item_id = n.item_id AND h.k = n.k GROUP BY 1")
def _(s, d):
    q = read(s, d, "benchmark").select("item_id", F.explode(F.array_distinct(tx.tokens(F.col("text")))).alias("t"))
    n = q.groupBy("item_id").agg(F.count("*").alias("k"))
    asked = q.select("t").distinct()
    w = read(s, d, "documents").select("doc_id", F.explode(F.array_distinct(tx.tokens(F.col("text")))).alias("t")).join(asked, "t")
    h = q.join(w, "t").groupBy("item_id", "doc_id").agg(F.count("*").alias("k"))
    return h.join(n, ["item_id", "k"]).groupBy("item_id").agg(F.count("*").alias("n_docs"))


@query("P10_coalesce", f"WITH {sql.OBJ} SELECT coalesce(authority, 'UNKNOWN') AS tier, count(*) AS n FROM obj WHERE (bytes > 1000 OR source_id = 'src1') AND NOT account_id = 'fr' GROUP BY 1")
def _(s, d):
    o = objects(s, d).filter(((F.col("bytes") > 1000) | (F.col("source_id") == "src1")) & ~(F.col("account_id") == "fr"))
    return o.groupBy(F.coalesce("authority", F.lit("UNKNOWN")).alias("tier")).agg(F.count("*").alias("n"))


# joins


@query("J01_inner_equi", "SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P'")
def _(s, d):
    o = read(s, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return read(s, d, "lineitem").select("l_orderkey", "l_linenumber").join(o, "l_orderkey").select("l_orderkey", "l_linenumber", "o_custkey")


@query("J02_left_outer", "SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def _(s, d):
    return read(s, d, "documents").select("doc_id").join(read(s, d, "labels"), "doc_id", "left").select("doc_id", "quality", "toxic")


@query("J05_left_anti_self", "SELECT c.conv_id, c.turn FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM conversations p WHERE p.conv_id = c.conv_id AND p.turn = c.turn - 1)")
def _(s, d):
    c = read(s, d, "conversations").select("conv_id", "turn")
    return c.join(c.select("conv_id", (F.col("turn") + 1).alias("turn")), ["conv_id", "turn"], "left_anti")


@query("J08_scalar_subquery", "SELECT c_custkey, (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey) AS n_orders FROM customer c")
def _(s, d):
    n = read(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"))
    return read(s, d, "customer").select("c_custkey").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n_orders", F.lit(0)).alias("n_orders"))


@query("J09_three_way", "SELECT n_name, r_name, count(*) AS n, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def _(s, d):
    c, n, r = (read(s, d, t) for t in ("customer", "nation", "region"))
    j = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, F.col("n_regionkey") == r["r_regionkey"])
    return j.groupBy("n_name", "r_name").agg(F.count("*").alias("n"), F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("double").alias("balance"))


@query("J13_edge_resolution", f"WITH {sql.MSG}, p AS (SELECT conv_id || '/' || turn AS s, conv_id || '/' || (turn - 1) AS t FROM msg), n AS (SELECT conv_id || '/' || turn AS k, object_id FROM msg) SELECT a.object_id AS source_object, b.object_id AS target_object, 'REPLIES_TO' AS relationship_type FROM p JOIN n a ON p.s = a.k JOIN n b ON p.t = b.k")
def _(s, d):
    m = messages(s, d)
    name = lambda t: F.concat_ws("/", F.col("conv_id").cast("string"), t.cast("string"))
    pending = m.select(name(F.col("turn")).alias("source_native"), name(F.col("turn") - 1).alias("target_native"), F.lit("REPLIES_TO").alias("type"))
    return canonical.resolve_edges(pending, m.select(name(F.col("turn")).alias("native_id"), "object_id"))[0]


@query("J14_full_outer", f"WITH {sql.OBJ}, l AS (SELECT content_hash, max(bytes) AS b FROM obj WHERE doc_id % 3 <> 0 GROUP BY 1), r AS (SELECT content_hash, max(bytes) AS b FROM obj WHERE doc_id % 3 <> 1 GROUP BY 1) SELECT coalesce(l.content_hash, r.content_hash) AS content_hash, coalesce(l.b, r.b) AS bytes, CASE WHEN r.content_hash IS NULL THEN 'send' WHEN l.content_hash IS NULL THEN 'remote_only' ELSE 'both' END AS action FROM l FULL JOIN r ON l.content_hash = r.content_hash")
def _(s, d):
    o = objects(s, d)
    return replication.blob_plan(o.filter("doc_id % 3 <> 0"), o.filter("doc_id % 3 <> 1"))


# aggregations, windows, limits, sets


@query("A01_dashboard", "SELECT 'documents' AS metric, count(*) AS value FROM documents UNION ALL SELECT 'bytes', CAST(sum(coalesce(n_chars, 0)) AS BIGINT) FROM documents UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'messages', count(*) FROM conversations UNION ALL SELECT 'conversations', count(DISTINCT conv_id) FROM conversations")
def _(s, d):
    one = lambda t, m, c: read(s, d, t).agg(c.cast("long").alias("value")).select(F.lit(m).alias("metric"), "value")
    n = F.count("*")
    parts = [one("documents", "documents", n), one("documents", "bytes", F.sum(F.coalesce("n_chars", F.lit(0)))), one("pages", "pages", n), one("events", "events", n), one("conversations", "messages", n), one("conversations", "conversations", F.countDistinct("conv_id"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("A02_group_count", "SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2")
def _(s, d):
    return read(s, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))


@query("A03_having_group_concat", "SELECT o_custkey, count(*) AS n, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS order_keys FROM orders GROUP BY 1 HAVING count(*) > 20")
def _(s, d):
    per = read(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("o_orderkey")).alias("k")).filter("n > 20")
    return per.select("o_custkey", "n", F.array_join(F.col("k").cast("array<string>"), ",").alias("order_keys"))


@query("A04_count_distinct", "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY 1 HAVING count(DISTINCT user_id) > 1")
def _(s, d):
    return read(s, d, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("users")).filter("users > 1")


@query("A05_span", "SELECT user_id, min(ts) AS first_seen, max(ts) AS last_seen FROM events GROUP BY 1")
def _(s, d):
    return read(s, d, "events").groupBy("user_id").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


@query("A06_domain_rollup", f"WITH {sql.VISIT} SELECT domain, count(*) AS n_visits, count(DISTINCT normalized_url) AS n_urls FROM visit GROUP BY 1")
def _(s, d):
    return visits(s, d).groupBy("domain").agg(F.count("*").alias("n_visits"), F.countDistinct("normalized_url").alias("n_urls"))


@query("A08_url_upsert", f"WITH {sql.VISIT} SELECT normalized_url, max(domain) AS domain, count(*) AS visit_count, min(ts) AS first_seen, max(ts) AS last_seen FROM visit GROUP BY 1")
def _(s, d):
    v = visits(s, d).withColumn("title", F.lit(None).cast("string"))
    half = F.pmod(F.col("event_id"), F.lit(2))
    old = canonical.record_visits(v.filter(half == 0))
    out = canonical.record_visits(v.filter(half == 1), old)
    return out.select("normalized_url", "domain", "visit_count", F.col("first_seen").cast("timestamp_ntz").alias("first_seen"), F.col("last_seen").cast("timestamp_ntz").alias("last_seen"))


@query("A09_conditional_counts", "SELECT lang, count(*) FILTER (WHERE n_chars > 2000) AS n_long, count(*) FILTER (WHERE text LIKE '%@%') AS n_at FROM documents GROUP BY 1")
def _(s, d):
    return read(s, d, "documents").groupBy("lang").agg(F.count_if(F.col("n_chars") > 2000).alias("n_long"), F.count_if(F.contains("text", F.lit("@"))).alias("n_at"))


@query("A10_ratio", "SELECT source, round(100.0 * count(*) FILTER (WHERE quality = 1) / greatest(count(*), 1), 2) AS percent_good FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def _(s, d):
    j = read(s, d, "documents").select("doc_id", "source").join(read(s, d, "labels"), "doc_id")
    return j.groupBy("source").agg(F.round(100.0 * F.count_if(F.col("quality") == 1) / F.greatest(F.count("*"), F.lit(1)), 2).alias("percent_good"))


@query("A11_document_frequency", f"WITH {sql.TOKENS} SELECT t AS term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM tok GROUP BY 1")
def _(s, d):
    t = read(s, d, "documents").select("doc_id", F.explode(tx.tokens(F.col("text"))).alias("term"))
    per = t.groupBy("term", "doc_id").agg(F.count("*").alias("k"))
    return per.groupBy("term").agg(F.sum("k").alias("tf"), F.count("*").alias("df"))


@query("W01_version_chain", "SELECT conv_id, turn, row_number() OVER w AS version_num, lag(turn) OVER w AS parent FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def _(s, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return read(s, d, "conversations").select("conv_id", "turn", F.row_number().over(w).alias("version_num"), F.lag("turn").over(w).alias("parent"))


@query("W02_latest_row", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def _(s, d):
    e = read(s, d, "events").groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id")).alias("e"))
    return e.select("user_id", "e.*")


@query("W03_canonical_member", f"WITH {sql.OBJ} SELECT object_id, min(object_id) OVER (PARTITION BY content_hash) AS canonical FROM obj")
def _(s, d):
    o = objects(s, d).select("object_id", "content_hash")
    least = o.groupBy("content_hash").agg(F.min("object_id").alias("canonical"))
    return o.join(least, "content_hash").select("object_id", "canonical")


@query("W05_dark_days", "SELECT strftime(x.day, '%Y-%m-%d') AS day FROM (SELECT unnest(generate_series(min(date_trunc('day', o_orderdate)), max(date_trunc('day', o_orderdate)), INTERVAL 1 DAY)) AS day FROM orders) x WHERE x.day NOT IN (SELECT date_trunc('day', o_orderdate) FROM orders WHERE o_orderstatus = 'P')")
def _(s, d):
    o = read(s, d, "orders")
    every = o.agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b")).select(F.explode(F.sequence(F.to_date("a"), F.to_date("b"))).alias("day"))
    seen = o.filter("o_orderstatus = 'P'").select(F.to_date("o_orderdate").alias("day")).distinct()
    return every.join(seen, "day", "left_anti").select(F.date_format("day", "yyyy-MM-dd").alias("day"))


@query("W06_max_normalise", "SELECT event_id, round(value / max(value) OVER (PARTITION BY event_type), 9) AS share FROM events")
def _(s, d):
    e = read(s, d, "events").select("event_id", "event_type", "value")
    top = e.groupBy("event_type").agg(F.max("value").alias("top"))
    return e.join(top, "event_type").select("event_id", F.round(F.col("value") / F.col("top"), 9).alias("share"))


@query("L01_top_customers", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 25")
def _(s, d):
    return read(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "o_custkey").limit(25)


@query("L05_cap_per_key", "SELECT c_nationkey, c_custkey, k FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS k FROM customer) WHERE k <= 3")
def _(s, d):
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return read(s, d, "customer").withColumn("k", F.row_number().over(w)).filter("k <= 3").select("c_nationkey", "c_custkey", "k")


@query("U01_union_all", f"WITH {sql.EDGE} SELECT source_object AS object_id, count(*) AS n FROM (SELECT source_object FROM edge UNION ALL SELECT target_object FROM edge) GROUP BY 1")
def _(s, d):
    e = relationships(s, d)
    ends = e.select(F.col("source_object").alias("object_id")).unionAll(e.select("target_object"))
    return ends.groupBy("object_id").agg(F.count("*").alias("n"))


@query("U02_difference", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def _(s, d):
    return read(s, d, "documents").select("doc_id").distinct().join(read(s, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("U03_intersection", "SELECT s_nationkey AS nationkey FROM supplier INTERSECT SELECT c_nationkey FROM customer WHERE c_acctbal > 9000")
def _(s, d):
    return read(s, d, "supplier").select(F.col("s_nationkey").alias("nationkey")).intersect(read(s, d, "customer").filter("c_acctbal > 9000").select("c_nationkey"))


# functions


@query("F01_hashes", f"WITH {sql.OBJ} SELECT object_id, content_hash, sha256(source_id || '|' || account_id || '|' || object_id) AS key_hash FROM obj")
def _(s, d):
    return objects(s, d).select("object_id", "content_hash", F.sha2(F.concat_ws("|", "source_id", "account_id", "object_id"), 256).alias("key_hash"))


_HUMAN = lambda n: f"CASE WHEN {n} IS NULL THEN NULL WHEN {n} < 1024 THEN printf('%d B', {n}) " + " ".join(f"WHEN {n} < {1 << k + 10} THEN printf('%.1f {u}B', {n} / {1 << k}.0)" for k, u in ((10, "K"), (20, "M"), (30, "G"))) + f" ELSE printf('%.1f TB', {n} / {1 << 40}.0) END"
_FORMS = [1, 5000, 5_000_000, 5_000_000_000, 5_000_000_000_000]


@query("F03_human_size", f"SELECT doc_id, {_HUMAN('n_chars')} AS size, concat_ws(' ', {', '.join(_HUMAN(f'((n_chars % 1000 + 1) * {k})') for k in _FORMS)}) AS forms FROM documents")
def _(s, d):
    """Each document's size, and sizes of all units made of its last digits."""
    forms = [tx.human_size((F.col("n_chars") % 1000 + 1) * F.lit(k).cast("long")) for k in _FORMS]
    return read(s, d, "documents").select("doc_id", tx.human_size(F.col("n_chars")).alias("size"), F.concat_ws(" ", *forms).alias("forms"))


@query("F05_url_canonical", f"WITH {sql.URL} SELECT page_id, normalized_url, domain FROM u")
def _(s, d):
    return urls(s, d).select("page_id", "normalized_url", "domain")


# forms of each page's URL that every rule meets, in words that Spark and DuckDB share
_URL_FORMS = [
    "concat('mailto:joe', page_id, '@example.com')", "concat('javascript:location.href=', url)", "concat(url, '?q=&b&UTM_Source=x&a=%7E+1&a=*%20c&ref_src=y')", "concat('//', split_part(url, '://', 2))",
    "split_part(url, '://', 2)", "concat('localhost:8080/x', page_id)", "concat('HTTP://user:pw@WWW.Site', page_id, '.Example.COM:80/A/Index.HTML#!route')", "concat('https://site', page_id, '.example.com:8443//')",
    "concat('http://.bad', page_id, '.example/')", "concat('  http://a', page_id, '.example/default.php?z=1&y=2#top ')",
]
_URL_FORMS_SQL = "forms AS (" + " UNION ALL ".join(f"SELECT page_id, {k} AS form, {x} AS url FROM pages" for k, x in enumerate(_URL_FORMS)) + ")"


@query("F05_url_rules", f"WITH {_URL_FORMS_SQL}, {sql.url_rules('forms')} SELECT page_id, form, normalized_url, domain, scheme FROM u")
def _(s, d):
    p = read(s, d, "pages")
    forms = F.explode(F.array(*[F.struct(F.lit(k).alias("form"), F.expr(x).alias("url")) for k, x in enumerate(_URL_FORMS)]))
    return p.select("page_id", forms.alias("f")).select("page_id", "f.form", canonicalize_url(F.col("f.url")).alias("c")).select("page_id", "form", "c.normalized_url", "c.domain", "c.scheme")


@query("F06_registrable_domain", f"WITH {sql.URL} SELECT page_id, {sql.REGISTRABLE} AS registrable FROM u")
def _(s, d):
    return urls(s, d).select("page_id", registrable_domain(F.col("domain")).alias("registrable"))


@query("F08_month_buckets", "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1")
def _(s, d):
    return read(s, d, "orders").groupBy(month(F.col("o_orderdate")).alias("month")).agg(F.count("*").alias("n"))


@query("F12_tokens", f"WITH {sql.TOKENS} SELECT doc_id, count(*) AS n_tokens FROM tok GROUP BY 1")
def _(s, d):
    return read(s, d, "documents").select("doc_id", F.size(tx.tokens(F.col("text"))).cast("long").alias("n_tokens")).filter("n_tokens > 0")


@query("F13_stop_words", f"WITH {sql.TOKENS} SELECT doc_id, count(*) AS n_content FROM tok WHERE t NOT IN ({sql.STOPS}) GROUP BY 1")
def _(s, d):
    t = tx.tokens(F.col("text"))
    return read(s, d, "documents").select("doc_id", F.size(F.filter(t, lambda x: ~tx.is_stop_word(x))).cast("long").alias("n_content")).filter("n_content > 0")


@query("F14_identifiers", f"WITH {sql.TOKENS} SELECT t AS term, count(*) AS n FROM tok WHERE regexp_matches(t, '^[0-9]+$') OR regexp_matches(t, '^[0-9a-f]{{8,}}$') OR length(t) > 20 OR (length(t) >= 12 AND regexp_matches(t, '[0-9]')) OR length(regexp_replace(t, '[^0-9]', '', 'g')) > 0.3 * length(t) GROUP BY 1")
def _(s, d):
    t = read(s, d, "documents").select(F.explode(F.filter(tx.tokens(F.col("text")), tx.is_identifier)).alias("term"))
    return t.groupBy("term").agg(F.count("*").alias("n"))


@query("F16_chrome_time", "SELECT event_id, ts FROM events")
def _(s, d):
    micros = F.unix_micros(F.col("ts").cast("timestamp")) + F.lit(11644473600000000)
    return read(s, d, "events").select("event_id", chrome_ts(micros).cast("timestamp_ntz").alias("ts"))


@query("F17_epoch_time", "SELECT event_id, date_trunc('second', ts) AS ts FROM events")
def _(s, d):
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    return read(s, d, "events").select("event_id", from_epoch(seconds).cast("timestamp_ntz").alias("ts"))


@query("F25_word_count", "SELECT doc_id, CAST(len(regexp_split_to_array(trim(text), '\\s+')) AS INTEGER) AS n_words FROM documents WHERE trim(text) <> ''")
def _(s, d):
    return read(s, d, "documents").filter(F.trim("text") != "").select("doc_id", tx.word_count(F.col("text")).alias("n_words"))


@query("F26_detag", f"SELECT page_id, {sql.DETAG} AS text FROM pages")
def _(s, d):
    return read(s, d, "pages").select("page_id", tx.detag(F.col("html")).alias("text"))


@query("F31_json_field", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def _(s, d):
    return read(s, d, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "long").alias("k"))


@query("F33_authority", f"WITH {sql.OBJ} SELECT object_id, CAST(CASE authority {sql.AUTHORITY} ELSE 0.3 END AS DOUBLE) AS weight FROM obj")
def _(s, d):
    return objects(s, d).select("object_id", tx.authority_weight(F.col("authority")).alias("weight"))


# canonical, dedup


@query("N01_ingest_outcomes", "WITH b AS (SELECT o_orderkey, o_totalprice AS old, CASE WHEN o_orderkey % 10 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS new FROM orders) SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'created' WHEN old = new THEN 'unchanged' ELSE 'versioned' END AS outcome, CASE WHEN o_orderkey % 7 = 0 THEN 1 WHEN old = new THEN 1 ELSE 2 END AS new_version FROM b")
def _(s, d):
    o = read(s, d, "orders")
    key = [F.lit("orders").alias("source_id"), F.lit(None).cast("string").alias("account_id"), F.col("o_orderkey").cast("string").alias("native_id")]
    sha = lambda c: F.sha2(c.cast("string"), 256).alias("content_hash")
    have = o.filter("o_orderkey % 7 <> 0").select(*key, tx.object_id(F.col("o_orderkey")).alias("object_id"), sha(F.col("o_totalprice")), F.lit(1).alias("version_num"))
    price = F.when(F.col("o_orderkey") % 10 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    items = o.select("o_orderkey", *key, sha(price), F.lit(0).alias("seq"))
    return canonical.ingest_outcomes(items, have).select("o_orderkey", "outcome", "new_version")


@query("N02_allocate_ids", "SELECT c_name, printf('KB-%08d', 1000 + row_number() OVER (ORDER BY c_name)) AS object_id FROM customer")
def _(s, d):
    return canonical.allocate_ids(read(s, d, "customer").select("c_name"), "c_name", 1000)


@query("N03_current_objects", f"WITH {sql.OBJ} SELECT object_id, content_hash FROM (SELECT *, min(object_id) OVER (PARTITION BY content_hash) AS c FROM obj) WHERE c = object_id")
def _(s, d):
    o = objects(s, d)
    return canonical.current_objects(dedupe.with_aliases(o, dedupe.link_duplicates(o))).select("object_id", "content_hash")


@query("N04_resolve_edges", f"WITH {sql.EDGE} SELECT source_object, target_object, relationship_type FROM edge")
def _(s, d):
    return relationships(s, d).distinct()


@query("N05_wikilinks", f"WITH {sql.OBJ}, l AS (SELECT native_path AS source_path, 'doc' || (doc_id // 2) AS target FROM obj), f AS (SELECT native_path AS path, 'doc' || doc_id AS stem FROM obj) SELECT l.source_path, l.target, CASE WHEN f.path IS NULL THEN 'MISSING' ELSE 'OK' END AS status, f.path FROM l LEFT JOIN f ON l.target = f.stem")
def _(s, d):
    o = objects(s, d)
    links = o.select(F.col("native_path").alias("source_path"), F.concat(F.lit("doc"), F.floor(F.col("doc_id") / 2).cast("string")).alias("target"))
    return canonical.resolve_wikilinks(links, o.select(F.col("native_path").alias("path")))


@query("N08_register_dimensions", "SELECT DISTINCT source AS source_id, lang AS account_id FROM documents WHERE NOT (lang = 'en')")
def _(s, d):
    o = objects(s, d).select("source_id", "account_id")
    return canonical.register_dimensions(o, o.filter("account_id = 'en'").distinct(), ["source_id", "account_id"])


@query("D01_exact_duplicates", f"WITH {sql.OBJ} SELECT content_hash, min(object_id) AS canonical, count(*) AS n, CAST(sum(bytes) // count(*) AS BIGINT) AS bytes_each FROM obj GROUP BY 1 HAVING count(*) > 1")
def _(s, d):
    return dedupe.exact_duplicates(objects(s, d))


@query("D02_url_variants", f"""WITH {sql.URL}, x AS (SELECT DISTINCT normalized_url FROM u WHERE normalized_url IS NOT NULL) SELECT regexp_replace(normalized_url, '^[^:/?#]*://', '') AS "key", count(*) AS n, min(normalized_url) AS "first" FROM x GROUP BY 1 HAVING count(*) > 1""")
def _(s, d):
    return dedupe.url_variants(urls(s, d))


@query("D03_link_duplicates", f"WITH {sql.OBJ} SELECT object_id AS alias, c AS canonical, 'exact' AS kind, CAST(1.0 AS DOUBLE) AS confidence FROM (SELECT *, min(object_id) OVER (PARTITION BY content_hash) AS c FROM obj) WHERE c <> object_id")
def _(s, d):
    return dedupe.link_duplicates(objects(s, d))


@query("D04_reclaimable", f"WITH {sql.OBJ}, g AS (SELECT count(*) AS n, sum(bytes) // count(*) AS b FROM obj GROUP BY content_hash HAVING count(*) > 1) SELECT count(*) AS n_groups, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(b * (n - 1)), 0) AS BIGINT) AS bytes FROM g")
def _(s, d):
    return dedupe.reclaimable(dedupe.exact_duplicates(objects(s, d)))


@query("D05_exclusive_cost", f"WITH {sql.OBJ}, g AS (SELECT bool_and(source_id = 'src1') AS a, bool_or(source_id = 'src1') AS b, max(bytes) AS bytes FROM obj GROUP BY content_hash) SELECT CASE WHEN a THEN 'exclusive' WHEN b THEN 'shared' ELSE 'kept' END AS kind, count(*) AS blobs, CAST(sum(bytes) AS BIGINT) AS bytes FROM g GROUP BY 1")
def _(s, d):
    return dedupe.exclusive_cost(objects(s, d), F.col("source_id") == "src1")


# graph


@query("G02_domain_edges", f"WITH {sql.URL} SELECT DISTINCT normalized_url, {sql.REGISTRABLE} AS title, 'HOSTED_AT' AS relationship_type FROM u WHERE normalized_url IS NOT NULL")
def _(s, d):
    return graph.domain_entities(urls(s, d))[1]


@query("G03_workspace_edges", f"WITH {sql.OBJ} SELECT DISTINCT object_id, source_id AS title, 'BELONGS_TO' AS relationship_type FROM obj WHERE source_id IS NOT NULL")
def _(s, d):
    return graph.group_entities(objects(s, d), "source_id", "BELONGS_TO")


@query("G05_folder_edges", f"WITH {sql.OBJ} SELECT object_id, source_id AS title, 'STORED_IN' AS relationship_type FROM obj WHERE native_path IS NOT NULL")
def _(s, d):
    return graph.folder_entities(objects(s, d))


@query("G04_account_edges", f"WITH {sql.OBJ}, {sql.MSG}, c AS (SELECT DISTINCT conversation_id, 'conv' || conv_id AS account_id FROM msg) SELECT conversation_id AS object_id, account_id AS title, 'BELONGS_TO' AS relationship_type FROM c")
def _(s, d):
    conversations = messages(s, d).select(F.col("conversation_id").alias("object_id"), F.lit("Conversation").alias("object_class"), F.concat(F.lit("conv"), F.col("conv_id").cast("string")).alias("account_id")).distinct()
    return graph.account_entities(conversations.unionByName(objects(s, d).select("object_id", "object_class", "account_id")))


@query("G06_mentions", sql.MENTIONS)
def _(s, d):
    sites = urls(s, d).filter("domain is not null")
    labels = sites.select(F.explode(F.split("domain", r"\.")).alias("title"))
    return graph.mentions(objects(s, d), labels.unionByName(sites.select(registrable_domain(F.col("domain")).alias("title"))))


@query("G08_retire_orphans", f"WITH {sql.OBJ}, {sql.MSG}, t AS (SELECT DISTINCT conversation_id AS object_id FROM msg WHERE turn >= 4), e AS (SELECT DISTINCT conversation_id AS object_id FROM msg) SELECT object_id, CASE WHEN object_id IN (SELECT object_id FROM t) THEN 'CURRENT' ELSE 'SUPERSEDED' END AS decay_status FROM e")
def _(s, d):
    m = messages(s, d)
    entities = m.select(F.col("conversation_id").alias("object_id")).distinct().withColumns({"decay_status": F.lit("CURRENT"), "is_duplicate_of": F.lit(None).cast("string")})
    return graph.retire_orphans(entities, m.filter("turn >= 4").select(F.col("conversation_id").alias("target_object")))


@query("G09_graph_stats", f"WITH {sql.EDGE} SELECT relationship_type, count(*) AS n, count(DISTINCT source_object) AS sources, count(DISTINCT target_object) AS targets FROM edge GROUP BY 1")
def _(s, d):
    return graph.graph_stats(relationships(s, d))


@query("G10_neighbours", f"WITH {sql.EDGE}, x AS (SELECT source_object AS object_id, target_object AS neighbour, relationship_type, 'out' AS direction FROM edge UNION ALL SELECT target_object, source_object, relationship_type, 'in' FROM edge), r AS (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY direction, relationship_type, neighbour) AS k FROM x) SELECT object_id, neighbour, relationship_type, direction FROM r WHERE k <= 25")
def _(s, d):
    e = relationships(s, d)
    ids = e.select(F.col("source_object").alias("object_id")).union(e.select("target_object")).distinct()
    return graph.neighbours(e, ids, 25)


@query("G11_find_entities", f"WITH {sql.URL}, e AS (SELECT {sql.REGISTRABLE} AS title, count(DISTINCT normalized_url) AS n FROM u WHERE normalized_url IS NOT NULL GROUP BY 1) SELECT title AS object_id, title, n AS in_degree FROM e WHERE title ILIKE '%example%' ORDER BY n DESC, title LIMIT 15")
def _(s, d):
    entities, edges = graph.domain_entities(urls(s, d))
    return graph.find_entities(entities.select(F.col("title").alias("object_id"), "title"), edges.select(F.col("title").alias("target_object")), "example")


@query("G12_top_entities", f"WITH {sql.EDGE} SELECT target_object AS object_id, count(*) AS in_degree FROM edge GROUP BY 1 ORDER BY in_degree DESC, object_id LIMIT 20")
def _(s, d):
    return graph.by_in_degree(relationships(s, d), 20)


@query("G13_merge_entities", f"WITH {sql.EDGE}, m AS (SELECT source_object, CASE WHEN relationship_type = 'PART_OF' AND (CAST(substr(target_object, 4) AS BIGINT) - 50000000) % 2 = 1 THEN printf('KB-%08d', CAST(substr(target_object, 4) AS BIGINT) - 1) ELSE target_object END AS target_object, relationship_type FROM edge) SELECT DISTINCT source_object, target_object, relationship_type FROM m")
def _(s, d):
    c = read(s, d, "conversations").select("conv_id").distinct().filter("conv_id % 2 = 1")
    name = lambda c: tx.object_id(c + 50_000_000)
    decisions = c.select(name(F.col("conv_id") - 1).alias("canonical"), name(F.col("conv_id")).alias("alias"), F.lit("reviewer").alias("confirmed_by"))
    return graph.merge_entities(relationships(s, d), decisions)[0].select("source_object", "target_object", "relationship_type")


# search


def _queries(s, d):
    return read(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


@query("R01_index", f"WITH {sql.TOKENS} SELECT doc_id, t AS term, count(*) AS tf FROM tok GROUP BY 1, 2")
def _(s, d):
    o = objects(s, d)
    index = search.build_index(o.select(F.col("doc_id").alias("object_id"), "body"))
    return index["postings"].withColumnRenamed("object_id", "doc_id")


@query("R02_bm25", sql.BM25)
def _(s, d):
    docs = read(s, d, "documents").select(F.col("doc_id").alias("object_id"), F.col("text").alias("body"))
    return search.bm25(docs, search.query_terms(_queries(s, d)), 100).select("query_id", "object_id", "score")


@query("R03_expansion_terms", sql.EXPANSION_TERMS)
def _(s, d):
    docs = objects(s, d)
    terms = search.query_terms(_queries(s, d))
    return search.expansion_terms(docs, search.bm25(docs, terms, 100), terms)


@query("R05_match_entities", sql.ENTITIES_OF)
def _(s, d):
    entities = read(s, d, "part").select(tx.object_id(F.col("p_partkey")).alias("object_id"), F.col("p_name").alias("title"))
    asked = read(s, d, "part").filter("p_partkey % 50 = 0").select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("query"))
    return search.match_entities(asked, entities)


@query("R07_hybrid_rank", sql.HYBRID)
def _(s, d):
    o = objects(s, d).withColumn("modified_at", F.lit(None).cast("timestamp"))
    sources = o.select(F.col("source_id").alias("object_id"), F.col("source_id").alias("title")).distinct()
    edges = o.select(F.col("object_id").alias("source_object"), F.col("source_id").alias("target_object"))
    return search.search(o, _queries(s, d), sources, edges)


@query("R07_all_signals", sql.SIGNALS)
def _(s, d):
    """Hosts are entities that queries name, documents belong to the page of their number, and some are recent."""
    year = F.when(F.col("doc_id") % 3 == 0, 2026).when(F.col("doc_id") % 3 == 1, 2025).otherwise(2024)
    o = objects(s, d).withColumn("modified_at", F.make_timestamp(year, F.lit(6), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))
    sites = urls(s, d).select("page_id", F.try_element_at(F.split("domain", r"\."), F.lit(-3)).alias("label")).filter("label is not null")
    entities = sites.select(F.col("label").alias("object_id"), F.col("label").alias("title")).distinct()
    edges = sites.select(tx.object_id(F.col("page_id") + 1).alias("source_object"), F.col("label").alias("target_object"))
    return search.search(o, _queries(s, d), entities, edges, as_of_year=2026)


# provenance


def _chain(s, d):
    o = objects(s, d).withColumn("current_version_id", F.when(F.col("doc_id") % 11 != 0, tx.version_id(F.col("object_id"), F.lit(1))))
    v = o.filter("doc_id % 13 <> 0").select(tx.version_id(F.col("object_id"), F.lit(1)).alias("version_id"), "content_hash")
    p = o.filter("doc_id % 17 <> 0").select(F.col("doc_id").alias("provenance_id"), tx.version_id(F.col("object_id"), F.lit(1)).alias("version_id"), F.col("doc_id").alias("source_object_id"), F.col("content_hash").alias("evidence_hash"))
    b = o.filter("doc_id % 19 <> 0").select("content_hash")
    return provenance.provenance_chain(o.select("doc_id", "object_id", "current_version_id"), v, p, b)


@query("Q01_provenance_chain", f"WITH {sql.OBJ}, b AS (SELECT DISTINCT content_hash FROM obj WHERE doc_id % 19 <> 0) SELECT object_id, array_to_string(list_filter([CASE WHEN doc_id % 11 = 0 OR doc_id % 13 = 0 THEN 'no version' END, CASE WHEN doc_id % 11 = 0 OR doc_id % 17 = 0 THEN 'no provenance' END, CASE WHEN doc_id % 11 <> 0 AND doc_id % 17 <> 0 AND b.content_hash IS NULL THEN 'no evidence blob' END], lambda x: x IS NOT NULL), ';') AS breaks FROM obj LEFT JOIN b ON obj.content_hash = b.content_hash")
def _(s, d):
    return _chain(s, d).select("object_id", F.array_join("breaks", ";").alias("breaks"))


@query("Q02_cite", sql.CITE)
def _(s, d):
    e = objects(s, d).select(F.col("object_id").alias("source_object"), tx.object_id(F.floor(F.col("doc_id") / 2) + 1).alias("target_object"), F.lit("DERIVED_FROM").alias("relationship_type"))
    return provenance.cite(_chain(s, d), e.filter("source_object <> target_object"))


@query("Q03_coverage_gaps", "WITH h AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), w AS (SELECT DISTINCT 'src' || s_suppkey AS source FROM supplier) SELECT coalesce(w.source, h.source) AS source_id, coalesce(n, 0) AS n, n IS NOT NULL AS present FROM w FULL JOIN h ON w.source = h.source")
def _(s, d):
    declared = read(s, d, "supplier").select(F.concat(F.lit("src"), F.col("s_suppkey").cast("string")).alias("source_id"))
    return provenance.coverage_gaps(objects(s, d), declared)


@query("Q06_apply_verdicts", f"WITH {sql.OBJ} SELECT object_id, CASE WHEN quality = 1 THEN 'HUMAN_VALIDATED' WHEN quality = 0 THEN 'SYNTHESIZED' ELSE 'ORIGINAL' END AS knowledge_state, CASE WHEN quality = 0 THEN 'DISPUTED' ELSE 'CURRENT' END AS decay_status, CASE WHEN quality IS NULL THEN 1 ELSE 2 END AS version_num FROM obj LEFT JOIN labels USING (doc_id)")
def _(s, d):
    o = objects(s, d).select("object_id", F.lit("ORIGINAL").alias("knowledge_state"), "decay_status", F.lit(1).alias("version_num"))
    v = read(s, d, "labels").select(tx.object_id(F.col("doc_id") + 1).alias("object_id"), (F.col("quality") == 1).alias("accept"))
    return provenance.apply_verdicts(o, v)


# insight


@query("I01_gaps", f"WITH {sql.OBJ}, {sql.VISIT}, g AS (SELECT 'urls_never_visited' AS gap, count(*) AS n, 'medium' AS severity FROM pages WHERE page_id NOT IN (SELECT user_id FROM events) UNION ALL SELECT 'objects_without_label', count(*), 'low' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'objects_with_secrets', count(*), 'high' FROM documents WHERE regexp_matches(text, '{sql.TOKEN_ASSIGNMENT}')) SELECT gap, n, severity FROM g WHERE n > 0")
def _(s, d):
    docs, pages = read(s, d, "documents"), read(s, d, "pages")
    seen = read(s, d, "events").select(F.col("user_id").alias("page_id"))
    never = pages.join(seen, "page_id", "left_anti")
    bare = docs.select("doc_id").join(read(s, d, "labels"), "doc_id", "left_anti")
    secret = docs.filter(F.array_contains(secretscan.scan_body(F.col("text")), "token_assignment"))
    return insight.gaps([insight.gap(never, "urls_never_visited", "medium"), insight.gap(bare, "objects_without_label", "low"), insight.gap(secret, "objects_with_secrets", "high")])


@query("I02_months_dark", "WITH s AS (SELECT * FROM orders WHERE month(o_orderdate) NOT IN (2, 7)), x AS (SELECT unnest(generate_series(date_trunc('month', min(o_orderdate)), date_trunc('month', max(o_orderdate)), INTERVAL 1 MONTH)) AS m FROM s) SELECT strftime(m, '%Y-%m') AS month FROM x WHERE strftime(m, '%Y-%m') NOT IN (SELECT strftime(o_orderdate, '%Y-%m') FROM s)")
def _(s, d):
    o = read(s, d, "orders").filter(~F.month("o_orderdate").isin(2, 7))
    return insight.months_dark(o.withColumn("ts", F.col("o_orderdate").cast("timestamp")), "ts")


@query("I03_shares", f"WITH {sql.OBJ}, a AS (SELECT 'authority' AS section, authority AS k, count(*) AS n FROM obj GROUP BY 2), b AS (SELECT 'account_id' AS section, account_id AS k, count(*) AS n FROM obj GROUP BY 2), u AS (SELECT * FROM a UNION ALL SELECT * FROM b) SELECT section, k AS \"key\", n, round(100.0 * n / sum(n) OVER (PARTITION BY section), 2) AS percent FROM u")
def _(s, d):
    o = objects(s, d)
    return insight.shares(o, "authority").unionByName(insight.shares(o, "account_id"))


@query("I04_read_vs_write", "SELECT (SELECT count(*) FROM documents) AS stored, count(DISTINCT doc_id) AS surfaced, round(100.0 * count(DISTINCT doc_id) / (SELECT greatest(count(*), 1) FROM documents), 2) AS percent FROM labels")
def _(s, d):
    surfaced = read(s, d, "labels").select(tx.object_id(F.col("doc_id") + 1).alias("object_id"))
    return insight.read_vs_write(objects(s, d), surfaced)


@query("I05_history", f"WITH {sql.VISIT} SELECT count(*) AS n_visits, count(DISTINCT normalized_url) AS n_urls, count(DISTINCT domain) AS n_domains, min(ts) AS first_seen, max(ts) AS last_seen FROM visit")
def _(s, d):
    h = insight.history(visits(s, d))
    return h.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_seen", "last_seen")})


@query("I05_top_domains", f"WITH {sql.VISIT} SELECT domain, count(*) AS n_visits, count(DISTINCT normalized_url) AS n_urls FROM visit GROUP BY 1 ORDER BY n_visits DESC, domain LIMIT 25")
def _(s, d):
    return insight.top_domains(visits(s, d))


@query("I06_inventory", f"WITH {sql.OBJ} SELECT source_id, account_id, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes FROM obj GROUP BY 1, 2")
def _(s, d):
    return objects(s, d).groupBy("source_id", "account_id").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


# validation


@query("V_checks", "WITH c AS (SELECT 'line_has_order' AS \"check\", count(*) AS violations FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'turn_has_parent', count(*) FROM conversations c WHERE turn > 0 AND NOT EXISTS (SELECT 1 FROM conversations p WHERE p.conv_id = c.conv_id AND p.turn = c.turn - 1) UNION ALL SELECT 'document_is_labelled', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'known_role', count(*) FROM conversations WHERE role NOT IN ('user', 'assistant') UNION ALL SELECT 'unique_text', count(*) FROM (SELECT text FROM documents GROUP BY text HAVING count(*) > 1)) SELECT \"check\", violations, CASE WHEN violations = 0 THEN 'OK' ELSE 'ERROR' END AS status FROM c")
def _(s, d):
    c = read(s, d, "conversations")
    lines = validate.versions_without_provenance(read(s, d, "lineitem").select(F.col("l_orderkey").alias("version_id")), read(s, d, "orders").select(F.col("o_orderkey").alias("version_id")))
    name = lambda t: F.concat_ws("/", F.col("conv_id").cast("string"), t.cast("string"))
    chain = validate.broken_chains(c.select(name(F.col("turn")).alias("version_id"), F.when(F.col("turn") > 0, name(F.col("turn") - 1)).alias("parent_version_id"), (F.col("turn") + 1).alias("version_num")))
    label = read(s, d, "labels").select(F.col("doc_id").alias("object_id"))
    docs = read(s, d, "documents")
    out = validate.check(lines, "line_has_order")
    for rows, check in (
        (chain, "turn_has_parent"), (validate.objects_without_events(docs.select(F.col("doc_id").alias("object_id")), label), "document_is_labelled"),
        (validate.unlisted_values(c, "role", ["user", "assistant"]), "known_role"), (validate.repeated_keys(docs.select(F.sha2("text", 256).alias("h")), ["h"]), "unique_text"),
    ):
        out = out.unionByName(validate.check(rows, check))
    return out


@query("V05_account_boundaries", "WITH a AS (SELECT 'n' || c_nationkey AS source_id, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_mktsegment END AS account_id, c_custkey FROM customer) SELECT c_custkey FROM a WHERE account_id IS NULL AND source_id IN (SELECT source_id FROM a WHERE account_id IS NOT NULL)")
def _(s, d):
    a = read(s, d, "customer").select("c_custkey", F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("source_id"), F.when(F.col("c_custkey") % 9 != 0, F.col("c_mktsegment")).alias("account_id"))
    return validate.missing_accounts(a, a).select("c_custkey")


@query("V06_shared_across_accounts", "SELECT sha256(text) AS object_id, count(DISTINCT coalesce(source, '~')) AS n FROM documents GROUP BY 1 HAVING count(DISTINCT coalesce(source, '~')) > 1")
def _(s, d):
    return validate.shared_across_accounts(objects(s, d).select(F.col("content_hash").alias("object_id"), F.col("source_id").alias("account_id")))


@query("V14_blob_states", f"WITH {sql.OBJ} SELECT object_id, CASE WHEN doc_id % 5 = 0 THEN 'missing' WHEN doc_id % 5 = 1 THEN 'corrupt' ELSE 'ok' END AS state FROM obj")
def _(s, d):
    o = objects(s, d).withColumn("content_hash", F.sha2(F.concat_ws("|", "object_id", "body"), 256))
    files = o.filter("doc_id % 5 <> 0").select("content_hash", F.when(F.col("doc_id") % 5 == 1, F.col("body")).otherwise(F.concat_ws("|", "object_id", "body")).cast("binary").alias("content"))
    states = validate.blob_states(o.select("content_hash"), files)
    return o.select("object_id", "content_hash").join(states, "content_hash").select("object_id", "state")


# secrets, replication, streams


@query("X01_scan_body", f"SELECT doc_id, 'token_assignment' AS kinds FROM documents WHERE regexp_matches(text, '{sql.TOKEN_ASSIGNMENT}')")
def _(s, d):
    found = read(s, d, "documents").select("doc_id", secretscan.scan_body(F.col("text")).alias("k")).filter(F.size("k") > 0)
    return found.select("doc_id", F.array_join("k", ",").alias("kinds"))


# a made-up secret of each kind from a text's digest h: (kind, what stands before, the secret, what stands after), in words
# that Spark and DuckDB share; and placeholders, which are none
_PLANTED = [
    ("assistant_key", "'key '", "concat('sk-ant-', substr(h, 1, 24))", "' your_team'"), ("aws_key", "''", "concat('AKIA', upper(substr(h, 1, 16)))", "'.'"),
    ("connection_string", "'at '", "concat('postgres://svc:', substr(h, 1, 12), '@db.internal')", "'/x?owner=your_team'"), ("github_token", "'('", "concat('ghp_', substr(h, 1, 36))", "')'"),
    ("google_key", "'k='", "concat('AIza', substr(h, 1, 35))", "' now'"), ("jwt", "'Bearer '", "concat('eyJ', substr(h, 1, 12), '.', substr(h, 13, 12), '.', substr(h, 25, 12))", "''"),
    ("mail_key", "'mail '", "concat('SG.', substr(h, 1, 20), '.', substr(h, 21, 20))", "' end'"), ("notes_token", "'n '", "concat('ntn_', substr(h, 1, 32))", "'!'"),
    ("token_assignment", "'so '", "concat('password = \"', substr(h, 1, 20), '\"')", "' and more'"), ("url_token", "'https://x.example/d'", "concat('?token=', substr(h, 1, 24))", "'&page=2'"),
    (None, "'at '", "concat('postgres://user:pass@db/', h)", "''"), (None, "'set '", "'token = \"YOUR_TOKEN_GOES_HERE_SOON\"'", "concat(' ', h)"),
]
_PLANTED_CASE = lambda of: "CASE doc_id % " + str(len(_PLANTED)) + " " + " ".join(f"WHEN {k} THEN {of(*x)}" for k, x in enumerate(_PLANTED)) + " END"
_PLANTED_BODY = _PLANTED_CASE(lambda kind, before, secret, after: f"concat({before}, {secret}, {after})")
_PLANTED_CLEAN = _PLANTED_CASE(lambda kind, before, secret, after: f"concat({before}, {repr(f'[REDACTED:{kind}]') if kind else secret}, {after})")


@query("X01_kinds_spans_redaction", f"SELECT doc_id, {_PLANTED_CASE(lambda kind, *_: repr(kind or ''))} AS kinds, {_PLANTED_CASE(lambda kind, before, secret, _: f'length({before}) || {chr(39)}:{chr(39)} || length(concat({before}, {secret})) || {chr(39)}:{kind}{chr(39)}' if kind else repr(''))} AS spans, {_PLANTED_CLEAN} AS body FROM (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents)")
def _(s, d):
    planted = read(s, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h")).select("doc_id", F.expr(_PLANTED_BODY).alias("body"))
    spans = F.transform(secretscan.scan_spans("body"), lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"), x["kind"]))
    return planted.select("doc_id", F.array_join(secretscan.scan_body(F.col("body")), ",").alias("kinds"), F.array_join(spans, ",").alias("spans"), secretscan.redact_text(F.col("body")).alias("body"))


@query("X03_redact", f"SELECT doc_id, regexp_replace(text, '{sql.TOKEN_ASSIGNMENT}', '[REDACTED:token_assignment]', 'g') AS body FROM documents")
def _(s, d):
    return read(s, d, "documents").select("doc_id", secretscan.redact_text(F.col("text")).alias("body"))


@query("X06_secret_report", f"SELECT 'token_assignment' AS kind, 'File' AS object_class, source AS source_id, count(*) AS n FROM documents WHERE regexp_matches(text, '{sql.TOKEN_ASSIGNMENT}') GROUP BY source")
def _(s, d):
    return secretscan.secret_report(objects(s, d))


@query("Y02_replication_plan", f"WITH {sql.OBJ}, l AS (SELECT content_hash, max(bytes) AS b FROM obj WHERE doc_id % 3 <> 0 GROUP BY 1), r AS (SELECT content_hash, max(bytes) AS b FROM obj WHERE doc_id % 3 <> 1 GROUP BY 1) SELECT CASE WHEN r.content_hash IS NULL THEN 'send' WHEN l.content_hash IS NULL THEN 'remote_only' ELSE 'both' END AS action, count(*) AS blobs, CAST(sum(coalesce(l.b, r.b)) AS BIGINT) AS bytes FROM l FULL JOIN r ON l.content_hash = r.content_hash GROUP BY 1")
def _(s, d):
    o = objects(s, d)
    return replication.replication_plan(o.filter("doc_id % 3 <> 0"), o.filter("doc_id % 3 <> 1"))


@query("Y06_replica_state", f"WITH {sql.OBJ} SELECT native_path AS path, CASE WHEN doc_id % 6 = 0 THEN 'LOCAL_NEWER' WHEN doc_id % 6 = 1 THEN 'REMOTE_NEWER' WHEN doc_id % 6 = 2 THEN 'CONFLICT' WHEN doc_id % 6 = 3 THEN 'LOCAL_DELETED' ELSE 'SAME' END AS state FROM obj WHERE native_path IS NOT NULL")
def _(s, d):
    o = objects(s, d).filter("native_path is not null").select("doc_id", F.col("native_path").alias("path"), F.col("content_hash").alias("hash"))
    edit = lambda name, *rests: o.withColumn("hash", F.when((F.col("doc_id") % 6).isin(*rests), F.concat(F.lit(name), "hash")).otherwise(F.col("hash")))
    return replication.replica_state(edit("l", 0, 2).filter("doc_id % 6 <> 3"), edit("r", 1, 2), o)


@query("T02_window_counts", "SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, round(CAST(sum(CAST(value AS DECIMAL(30,6))) AS DOUBLE), 2) AS total FROM events GROUP BY 1, 2")
def _(s, d):
    e = read(s, d, "events").withColumn("value", F.col("value").cast("decimal(30,6)"))
    return streams.windowed_counts(e).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round(F.col("total").cast("double"), 2).alias("total"))


@query("T04_sessions", "WITH a AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM a) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM s GROUP BY user_id, k")
def _(s, d):
    t = streams.activity_sessions(read(s, d, "events"))
    return t.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})


@query("Z04_dormancy", "WITH y AS (SELECT o_custkey, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1, 2), l AS (SELECT *, lag(y) OVER (PARTITION BY o_custkey ORDER BY y) AS p FROM y) SELECT o_custkey, y AS revived_in, p AS last_seen_in FROM l WHERE y - p > 1")
def _(s, d):
    y = read(s, d, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"))
    before = F.lag("y").over(Window.partitionBy("o_custkey").orderBy("y"))
    return y.withColumn("p", before).filter("y - p > 1").select("o_custkey", F.col("y").cast("long").alias("revived_in"), F.col("p").cast("long").alias("last_seen_in"))


# more forms


@query("J03_left_outer_bytes", f"WITH {sql.OBJ}, b AS (SELECT content_hash, max(bytes) AS blob_bytes FROM obj WHERE doc_id % 4 <> 0 GROUP BY 1) SELECT object_id, blob_bytes FROM obj LEFT JOIN b ON obj.content_hash = b.content_hash")
def _(s, d):
    o = objects(s, d)
    b = o.filter("doc_id % 4 <> 0").groupBy("content_hash").agg(F.max("bytes").alias("blob_bytes"))
    return o.select("object_id", "content_hash").join(b, "content_hash", "left").select("object_id", "blob_bytes")


@query("J04_left_join_is_null", "SELECT p_partkey FROM part LEFT JOIN (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity > 49) x ON p_partkey = l_partkey WHERE l_partkey IS NULL")
def _(s, d):
    sold = read(s, d, "lineitem").filter("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    return read(s, d, "part").select("p_partkey").join(sold, "p_partkey", "left_anti")


@query("J06_semi", "SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_returnflag = 'R')")
def _(s, d):
    back = read(s, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_suppkey").alias("s_suppkey"))
    return read(s, d, "supplier").select("s_suppkey").join(back, "s_suppkey", "left_semi")


@query("J07_null_safe_natural_key", "WITH a AS (SELECT c_custkey, NULLIF(c_mktsegment, 'BUILDING') AS seg, c_nationkey FROM customer), b AS (SELECT seg, c_nationkey, count(*) AS n FROM a GROUP BY 1, 2) SELECT c_custkey, n FROM a JOIN b ON a.seg IS NOT DISTINCT FROM b.seg AND a.c_nationkey = b.c_nationkey")
def _(s, d):
    a = read(s, d, "customer").select("c_custkey", F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("seg"), "c_nationkey")
    b = a.groupBy(F.col("seg").alias("s"), F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n"))
    return a.join(b, F.col("seg").eqNullSafe(F.col("s")) & (F.col("c_nationkey") == F.col("k"))).select("c_custkey", "n")


@query("J12_group_members", f"WITH {sql.OBJ} SELECT content_hash, string_agg(object_id, ',' ORDER BY object_id) AS members FROM obj GROUP BY 1 HAVING count(*) > 1")
def _(s, d):
    per = objects(s, d).groupBy("content_hash").agg(F.array_sort(F.collect_list("object_id")).alias("m")).filter(F.size("m") > 1)
    return per.select("content_hash", F.array_join("m", ",").alias("members"))


@query("J15_using", f"WITH {sql.VISIT} SELECT event_type, count(*) AS n FROM visit JOIN (SELECT normalized_url, count(*) AS k FROM visit GROUP BY 1) x USING (normalized_url) WHERE k > 50 GROUP BY 1")
def _(s, d):
    v = visits(s, d)
    busy = v.groupBy("normalized_url").agg(F.count("*").alias("k")).filter("k > 50")
    return v.join(busy, "normalized_url").groupBy(F.col("visit_kind").alias("event_type")).agg(F.count("*").alias("n"))


@query("A07_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def _(s, d):
    return read(s, d, "orders").select("o_orderstatus", "o_orderpriority").distinct()


@query("A12_set_from_json", "SELECT event_type, count(DISTINCT CAST(json_extract(props, '$.k') AS BIGINT)) AS n_keys FROM events GROUP BY 1")
def _(s, d):
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "long")
    return read(s, d, "events").groupBy("event_type").agg(F.countDistinct(k).alias("n_keys"))


@query("W04_top_per_entity", f"WITH {sql.OBJ} SELECT source_id, object_id, k FROM (SELECT source_id, object_id, row_number() OVER (PARTITION BY source_id ORDER BY bytes DESC, object_id) AS k FROM obj) WHERE k <= 5")
def _(s, d):
    w = Window.partitionBy("source_id").orderBy(F.desc("bytes"), "object_id")
    return objects(s, d).withColumn("k", F.row_number().over(w)).filter("k <= 5").select("source_id", "object_id", "k")


@query("L02_top_k_ties", f"WITH {sql.OBJ} SELECT object_id, bytes FROM obj ORDER BY bytes DESC, object_id LIMIT 50")
def _(s, d):
    return objects(s, d).select("object_id", "bytes").orderBy(F.desc("bytes"), "object_id").limit(50)


@query("L03_severity_order", "SELECT o_orderpriority, count(*) AS n, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END AS severity FROM orders GROUP BY 1")
def _(s, d):
    rank = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(2)
    per = read(s, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    return per.withColumn("severity", rank).orderBy("severity", F.desc("n"))


@query("U04_candidate_union", f"WITH {sql.OBJ}, a AS (SELECT object_id, 1.0 AS x FROM obj WHERE bytes > 3000), b AS (SELECT object_id, 1.0 AS y FROM obj WHERE source_id = 'src0') SELECT coalesce(a.object_id, b.object_id) AS object_id, CAST(coalesce(x, 0) + coalesce(y, 0) AS DOUBLE) AS score FROM a FULL JOIN b ON a.object_id = b.object_id")
def _(s, d):
    o = objects(s, d)
    a, b = o.filter("bytes > 3000").select("object_id", F.lit(1.0).alias("x")), o.filter("source_id = 'src0'").select("object_id", F.lit(1.0).alias("y"))
    return a.join(b, "object_id", "full_outer").select("object_id", (F.coalesce("x", F.lit(0.0)) + F.coalesce("y", F.lit(0.0))).alias("score"))


@query("F04_ids", "SELECT doc_id, printf('KB-%08d', doc_id + 1) AS object_id, printf('KB-%08d:v%02d', doc_id + 1, doc_id % 7 + 1) AS version_id FROM documents")
def _(s, d):
    o = tx.object_id(F.col("doc_id") + 1)
    return read(s, d, "documents").select("doc_id", o.alias("object_id"), tx.version_id(o, F.col("doc_id") % 7 + 1).alias("version_id"))


@query("F07_schemeless", f"""WITH {sql.URL} SELECT page_id, regexp_replace(normalized_url, '^[^:/?#]*://', '') AS "key" FROM u""")
def _(s, d):
    from cairnbook.functions.urls import schemeless

    return urls(s, d).select("page_id", schemeless(F.col("normalized_url")).alias("key"))


@query("F28_paths", f"WITH {sql.OBJ} SELECT object_id, '/store/' || source_id || '/' || account_id AS parent, 'doc' || doc_id AS stem, '.txt' AS suffix FROM obj")
def _(s, d):
    p = F.col("native_path")
    return objects(s, d).select("object_id", tx.parent_folder(p).alias("parent"), tx.file_stem(p).alias("stem"), tx.file_suffix(p).alias("suffix"))


@query("G07_rebuild", f"WITH {sql.EDGE} SELECT DISTINCT source_object, target_object, relationship_type FROM edge")
def _(s, d):
    e = relationships(s, d)
    old = e.withColumn("created_by", F.when(F.col("relationship_type") == "PART_OF", "rule:part"))
    derived = e.filter("relationship_type = 'PART_OF'").withColumn("created_by", F.lit("rule:part"))
    return graph.rebuild_edges(old, derived).select("source_object", "target_object", "relationship_type")


@query("Q04_evidence", sql.EVIDENCE)
def _(s, d):
    o = objects(s, d).withColumn("modified_at", F.lit(None).cast("timestamp"))
    return provenance.evidence(search.search(o, _queries(s, d), limit=8, expand=False, use_graph=False), o, _chain(s, d))


@query("Q05_record_answers", f"WITH {sql.OBJ} SELECT 'A-' || l.doc_id AS source_object, o.object_id AS target_object, 'DERIVED_FROM' AS relationship_type FROM labels l JOIN obj o ON o.doc_id = l.doc_id")
def _(s, d):
    answers = read(s, d, "labels").select(F.concat(F.lit("A-"), F.col("doc_id").cast("string")).alias("answer_id"), F.lit("text").alias("text"), F.array(tx.object_id(F.col("doc_id") + 1), F.lit("KB-none")).alias("sources"))
    return provenance.record_answers(answers, objects(s, d))[1]


@query("V08_aliases_have_links", f"WITH {sql.OBJ}, a AS (SELECT object_id, doc_id, min(object_id) OVER (PARTITION BY content_hash) AS c FROM obj) SELECT object_id FROM a WHERE c <> object_id AND doc_id % 2 = 0")
def _(s, d):
    o = objects(s, d)
    links = dedupe.link_duplicates(o)
    odd = links.filter(F.substring("alias", 4, 8).cast("long") % 2 == 0)  # ids are doc_id + 1
    return validate.aliases_without_links(dedupe.with_aliases(o, links), odd).select("object_id")


@query("X04_redact_at_ingest", f"SELECT doc_id, CASE WHEN regexp_matches(text, '{sql.TOKEN_ASSIGNMENT}') THEN '[WITHHELD: token_assignment]' ELSE text END AS body FROM documents")
def _(s, d):
    return read(s, d, "documents").select("doc_id", secretscan.redact_at_ingest(F.col("text")).alias("body"))


@query("Y01_store_manifest", f"WITH {sql.OBJ}, b AS (SELECT content_hash, max(bytes) AS x FROM obj GROUP BY 1) SELECT md5(min(object_id)) AS lineage, count(*) AS n_objects, max(object_id) AS high_water, (SELECT count(*) FROM b) AS n_blobs, (SELECT CAST(sum(x) AS BIGINT) FROM b) AS bytes FROM obj")
def _(s, d):
    o = objects(s, d)
    return replication.store_manifest(o.select("object_id", F.md5(F.col("object_id").cast("binary")).alias("uuid")), o.groupBy("content_hash").agg(F.max("bytes").alias("bytes")))


@query("Y04_restore_drill", "SELECT 'documents' AS \"table\", (SELECT count(*) FROM documents WHERE doc_id % 10 <> 0) AS snapshot_rows, count(*) AS live_rows, count(*) FILTER (WHERE doc_id % 10 = 0) AS lost FROM documents UNION ALL SELECT 'pages', count(*), count(*), 0 FROM pages")
def _(s, d):
    docs, pages = read(s, d, "documents"), read(s, d, "pages")
    return replication.restore_drill({"documents": docs.filter("doc_id % 10 <> 0"), "pages": pages}, {"documents": docs, "pages": pages})


@query("Y05_recovery_position", "WITH x AS (SELECT event_type AS tier, max(ts) AS newest, max(ts) FILTER (WHERE event_id % 3 = 0) AS last_proven, count(*) AS n, count(*) FILTER (WHERE value > 50) AS with_evidence FROM events GROUP BY 1) SELECT tier, n, newest, last_proven, with_evidence, CASE WHEN last_proven IS NULL THEN 'never proven' END AS warning FROM x")
def _(s, d):
    e = read(s, d, "events").select(F.col("event_type").alias("tier"), F.col("ts").alias("taken_at"), (F.col("event_id") % 3 == 0).alias("proven"), (F.col("value") > 50).alias("with_evidence"))
    return replication.recovery_position(e, e.select("tier").distinct())


@query("T03_replay_safe_log", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def _(s, d):
    e = read(s, d, "events")
    return streams.dedup_stream(e.unionAll(e.filter("event_id % 5 = 0"))).groupBy("event_type").agg(F.count("*").alias("n"))


@query("T06_late_rows", "SELECT count(*) FILTER (WHERE ts >= w) AS in_time, count(*) FILTER (WHERE ts < w) AS late FROM events, (SELECT max(ts) - INTERVAL 1 DAY AS w FROM events)")
def _(s, d):
    e = read(s, d, "events").select("event_id", "ts")
    mark = e.agg((F.max("ts") - F.expr("interval 1 day")).alias("watermark"))
    good, late = streams.late_rows(e, mark)
    n = good.agg(F.count("*").alias("in_time"))
    return n.join(F.broadcast(late.agg(F.count("*").alias("late"))))  # one row each
