"""Registered queries that fill a store of their own from the tables: ingestion, graph rebuilds, stored files, bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnbook.functions import text as tx
from cairnbook.functions.lineage import new_folder, stored
from cairnbook.operators import bundles, ingest, rebuild
from cairnbook.plans import sql
from cairnbook.plans.registry import query
from cairnbook.plans.tables import messages, objects, read, urls, visits

# ingestion


def _items(s, d):
    o = objects(s, d)
    return o.select("doc_id", "source_id", "account_id", F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("native_id"), "content_hash", F.concat(F.lit("t"), F.col("doc_id").cast("string")).alias("title"), "body", "native_path", "authority")


def two_batches(s, d, path: str) -> None:
    """Six of seven documents; then all, a tenth of them changed and each of those twice in the batch; then the same
    batch replayed."""
    items = _items(s, d)
    v = visits(s, d).select("normalized_url", "domain", "ts", F.col("visit_kind").alias("title"))
    ingest.ingest_batch(s, path, items.filter("doc_id % 7 <> 0"), 1, "2026-01-01", visits=v.filter("event_id % 2 = 0"))
    edit = lambda mark, seq: items.filter("doc_id % 10 = 0").withColumns({"body": F.concat("body", F.lit(mark)), "content_hash": F.sha2(F.concat("body", F.lit(mark)), 256), "seq": F.lit(seq)})
    second = items.filter("doc_id % 10 <> 0").withColumn("seq", F.lit(0)).unionByName(edit("!", 1)).unionByName(edit("?", 2))
    for _ in range(2):
        ingest.ingest_batch(s, path, second, 2, "2026-01-02", visits=v)


_INGESTED = f"""{sql.OBJ}, {sql.VISIT.replace('WITH ', '')}, i AS (
  SELECT *, 'doc' || doc_id AS native_id, row_number() OVER (PARTITION BY doc_id % 7 = 0 ORDER BY source_id, account_id, 'doc' || doc_id) + CASE WHEN doc_id % 7 = 0 THEN (SELECT count(*) FROM obj WHERE doc_id % 7 <> 0) ELSE 0 END AS n FROM obj
), ver AS (
  SELECT *, 1 AS v, text AS vbody, CASE WHEN doc_id % 7 = 0 THEN 2 ELSE 1 END AS batch FROM (SELECT *, body AS text FROM i) WHERE doc_id % 70 <> 0
  UNION ALL SELECT *, 1, body || '!', 2 FROM (SELECT *, body AS text FROM i) WHERE doc_id % 70 = 0
  UNION ALL SELECT *, CASE WHEN doc_id % 7 = 0 THEN 2 ELSE 3 END, body || '?', 2 FROM (SELECT *, body AS text FROM i) WHERE doc_id % 10 = 0
  UNION ALL SELECT *, 2, body || '!', 2 FROM (SELECT *, body AS text FROM i) WHERE doc_id % 10 = 0 AND doc_id % 7 <> 0
), x AS (
  SELECT *, printf('KB-%08d', n) AS object_id_, printf('KB-%08d:v%02d', n, v) AS version_id, v = 1 AS first, sha256(vbody) AS h, max(v) OVER (PARTITION BY doc_id) AS last FROM ver
)"""


@query(
    "N01_ingest_commit",
    f"""WITH {_INGESTED}
SELECT 'object_version' AS "table", version_id AS row_id, object_id_ AS object_id, concat_ws('|', v, CASE WHEN v > 1 THEN printf('KB-%08d:v%02d', n, v - 1) ELSE '-' END, CASE WHEN first THEN 'imported' ELSE 'normalized' END, h, batch) AS facts FROM x
UNION ALL SELECT 'provenance', 'PRV-' || version_id, object_id_, concat_ws('|', version_id, printf('SO-%08d', n), source_id, account_id, native_id, h, native_path, batch) FROM x
UNION ALL SELECT 'event', 'EVT-' || version_id, object_id_, concat_ws('|', CASE WHEN first THEN 'ACQUIRED' ELSE 'MODIFIED' END, CASE WHEN first THEN '-' ELSE 'ACQUIRED' END, CASE WHEN first THEN '-' ELSE 'content hash changed' END, batch) FROM x
UNION ALL SELECT 'object', object_id_, object_id_, concat_ws('|', 't' || doc_id, authority, 'ACQUIRED', version_id, batch) FROM x WHERE v = last
UNION ALL SELECT 'source_object', printf('SO-%08d', n), object_id_, concat_ws('|', source_id, account_id, native_id, h, v, batch) FROM x WHERE v = last
UNION ALL SELECT 'visit', normalized_url, strftime(ts, '%Y-%m-%d %H:%M:%S.%f'), concat_ws('|', max(domain), CASE WHEN bool_or(event_id % 2 = 0) THEN max(event_type) FILTER (WHERE event_id % 2 = 0) ELSE max(event_type) END, CASE WHEN bool_or(event_id % 2 = 0) THEN 1 ELSE 2 END) FROM visit GROUP BY normalized_url, ts""",
)
def _(s, d):
    """All tables of a store that three calls of two batches made."""
    path = new_folder(s, "ingest")
    two_batches(s, d, path)
    facts = {
        "object_version": ("version_id", "version_num", F.coalesce("parent_version_id", F.lit("-")), "change_type", "content_hash"),
        "provenance": ("provenance_id", "version_id", "source_object_id", "source_id", "account_id", "native_id", "original_hash", "original_path"),
        "event": ("event_id", "operation", F.coalesce("previous_state", F.lit("-")), F.coalesce("reason", F.lit("-"))),
        "object": ("object_id", "title", "authority", "lifecycle_state", "current_version"),
        "source_object": ("source_object_id", "source_id", "account_id", "native_id", "content_hash", "version_num"),
        "visit": ("normalized_url", "domain", "title"),
    }
    out = None
    for table, (row, *columns) in facts.items():
        rows = ingest.read_table(s, path, table)
        owner = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS") if table == "visit" else F.col("object_id")
        text = F.concat_ws("|", *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns], F.col("batch").cast("string"))
        one: DataFrame = rows.select(F.lit(table).alias("table"), F.col(row).alias("row_id"), owner.alias("object_id"), text.alias("facts"))
        out = one if out is None else out.unionByName(one)
    return out


@query("N01_current_bodies", f"WITH {_INGESTED} SELECT object_id_ AS object_id, doc_id, vbody AS body FROM x WHERE v = last")
def _(s, d):
    """What a reader sees after both batches: each object's current version."""
    path = new_folder(s, "ingest")
    two_batches(s, d, path)
    now = ingest.read_table(s, path, "object").select("object_id", F.col("current_version").alias("version_id"))
    names = ingest.read_table(s, path, "source_object").select("object_id", F.substring("native_id", 4, 18).cast("long").alias("doc_id"))
    return now.join(names, "object_id").join(ingest.read_table(s, path, "object_version").select("version_id", "body"), "version_id").select("object_id", "doc_id", "body")


# bundles and stored files

def _evidence(s, d) -> tuple[DataFrame, DataFrame]:
    """(objects, blobs) of a store of all documents."""
    o = objects(s, d).select("doc_id", "object_id", F.md5(F.col("object_id").cast("binary")).alias("uuid"), "content_hash", "body")
    return o.drop("body"), o.select("content_hash", F.col("body").cast("binary").alias("content"), F.octet_length("body").alias("bytes"))


def _bundle(s, d) -> tuple[str, DataFrame, DataFrame, DataFrame, DataFrame]:
    """A bundle for a replica that lacks a third of the documents and the last of them."""
    have, blobs = _evidence(s, d)
    old = have.filter("doc_id % 3 <> 1")
    old_blobs = blobs.join(old.select("content_hash"), "content_hash", "left_semi")
    path = new_folder(s, "bundle")
    bundles.export_bundle(have, blobs, path, old, old_blobs)
    return path, have, blobs, old, old_blobs


_SENT = "h AS (SELECT sha256(text) AS content_hash, doc_id, text FROM documents), sent AS (SELECT content_hash, max(strlen(text)) AS bytes, min(doc_id) AS k FROM h GROUP BY 1 HAVING bool_and(doc_id % 3 = 1))"


@query("K07_bundle_delta", f"WITH {_SENT} SELECT content_hash, bytes FROM sent")
def _(s, d):
    return s.read.parquet(f"{_bundle(s, d)[0]}/blobs").select("content_hash", "bytes")


@query(
    "K07_digest_tree",
    """WITH h AS (SELECT sha256(text) AS c, max(strlen(text)) AS bytes FROM documents GROUP BY 1), l AS (SELECT substr(c, 1, 4) AS prefix, count(*) AS n, sum(bytes) AS bytes, sha256(string_agg(c, chr(10) ORDER BY c)) AS digest FROM h GROUP BY 1),
b AS (SELECT substr(prefix, 1, 2) AS p, sum(n) AS n, sum(bytes) AS bytes, sha256(string_agg(prefix || ':' || digest, chr(10) ORDER BY prefix)) AS digest FROM l GROUP BY 1)
SELECT 2 AS level, prefix, n, CAST(bytes AS BIGINT) AS bytes, digest FROM l UNION ALL SELECT 1, p, CAST(n AS BIGINT), CAST(bytes AS BIGINT), digest FROM b UNION ALL SELECT 0, '', CAST(sum(n) AS BIGINT), CAST(sum(bytes) AS BIGINT), sha256(string_agg(p || ':' || digest, chr(10) ORDER BY p)) FROM b""",
)
def _(s, d):
    return bundles.digest_tree(_evidence(s, d)[1])


@query("Y03_damaged_bundle", f"WITH {_SENT} SELECT 'corrupt blob' AS refusal, count(*) AS n FROM sent WHERE k % 10 = 1 UNION ALL SELECT 'missing blob', count(*) FROM sent WHERE k % 10 IN (1, 4) UNION ALL SELECT 'leaf differs', count(DISTINCT substr(content_hash, 1, 4)) FROM sent WHERE k % 10 IN (1, 4)")
def _(s, d):
    """A bundle some of whose blobs got lost and others changed on the way."""
    path, have, _, old, old_blobs = _bundle(s, d)
    k = have.groupBy("content_hash").agg(F.min("doc_id").alias("k"))
    torn = new_folder(s, "bundle")
    for part in ("objects", "tree", "manifest"):
        s.read.parquet(f"{path}/{part}").write.parquet(f"{torn}/{part}")
    b = s.read.parquet(f"{path}/blobs").join(k, "content_hash").filter("k % 10 <> 4")
    b.withColumn("content", F.when(F.col("k") % 10 == 1, F.concat("content", F.lit("~").cast("binary"))).otherwise(F.col("content"))).drop("k").write.parquet(f"{torn}/blobs")
    return bundles.check_bundle(s, torn, old, old_blobs)


@query("Y03_applied_bundle", "SELECT printf('KB-%08d', doc_id + 1) AS object_id, sha256(text) AS content_hash, strlen(text) AS bytes FROM documents")
def _(s, d):
    """What the replica holds after the bundle: every object with its evidence."""
    path, _, _, old, old_blobs = _bundle(s, d)
    refused, have, blobs = bundles.apply_bundle(s, path, old, old_blobs)
    return have.select("object_id", "content_hash").join(blobs.select("content_hash", "bytes").dropDuplicates(["content_hash"]), "content_hash")


@query("Y03_refused_bundle", "SELECT 'this store is ahead' AS refusal, 1 AS n FROM documents HAVING count(*) > 1")
def _(s, d):
    """A bundle of an old store, for one that has gone on."""
    have, blobs = _evidence(s, d)
    last = have.agg(F.max("doc_id").alias("last"))
    path = new_folder(s, "bundle")
    bundles.export_bundle(have.join(F.broadcast(last), F.col("doc_id") < F.col("last")).drop("last"), blobs, path)  # one row
    return bundles.check_bundle(s, path, have, blobs).filter("refusal like '%ahead'")


_FILES = "b AS (SELECT sha256(text || chr(10)) AS h, min(doc_id) % 5 AS k FROM documents GROUP BY 1)"


@query(
    "V07_stored_files",
    f"""WITH {_FILES} SELECT h AS name, CASE WHEN k IN (0, 3) THEN 'missing' WHEN k = 1 THEN 'corrupt' ELSE 'ok' END AS state, false AS prunable FROM b
UNION ALL SELECT h || '.tmp-' || k, 'partial', k = 2 FROM b WHERE k IN (1, 2, 3) UNION ALL SELECT 'x' || h, 'foreign', false FROM b WHERE k = 4""",
)
def _(s, d):
    """A folder of files named by their hash, some lost, some changed, some torn, some of strangers."""
    t = read(s, d, "documents").select("doc_id", "text").withColumn("h", F.sha2(F.concat("text", F.lit("\n")), 256))
    first = stored(t.groupBy("h").agg(F.min("doc_id").alias("doc_id")))
    h, value, k = F.col("h"), F.col("value"), F.col("doc_id") % 5
    # of copies the first, of texts what goes into a file; dealt once, for the join and for those who write
    needed = t.filter(k != 0).select("h", "doc_id", F.when(k == 3, F.substring("text", 1, 10)).otherwise(F.col("text")).alias("value"))
    b = bundles.dealt(needed, "h", "doc_id").join(first, ["h", "doc_id"])
    file = lambda when, name, value: F.when(when, F.struct(name.alias("name"), F.concat(value, F.lit("\n")).alias("content")))
    whole = file(k != 3, h, F.when(k == 1, F.concat(value, F.lit("~"))).otherwise(value))
    torn = file(k.isin(1, 2, 3), F.concat(h, F.lit(".tmp-"), k.cast("string")), F.substring(value, 1, 10))
    other = file(k == 4, F.concat(F.lit("x"), h), F.lit("who knows"))
    path = new_folder(s, "files")
    bundles.write_files(b.select(F.inline(F.array_compact(F.array(whole, torn, other)))), path)
    return bundles.account_for_files(bundles.list_files(s, path), first.select(h.alias("content_hash")))


# graph rebuilds

_FROM = 90_000_000


def _rebuilt(s, d) -> dict[str, DataFrame]:
    """A graph over two thirds of the documents and half of the pages; then another over four fifths and all of them, which
    retires what only the first had; then the same again, which changes nothing. An acquired edge stays throughout."""
    docs = objects(s, d).select("doc_id", "object_id", "object_class", "source_id", "account_id", "native_path", "body")
    chats = messages(s, d).select("conv_id", F.col("conversation_id").alias("object_id")).distinct()
    text = lambda c: F.lit(c).cast("string")
    chats = chats.select(F.lit(None).cast("long").alias("doc_id"), "object_id", F.lit("Conversation").alias("object_class"), text(None).alias("source_id"), F.concat(F.lit("acct"), (F.col("conv_id") % 3).cast("string")).alias("account_id"), text(None).alias("native_path"), text(None).alias("body"))
    pages = urls(s, d).select("page_id", tx.object_id(F.col("page_id") + 70_000_000).alias("object_id"), "normalized_url", "domain")
    entities, edges = rebuild.empty_graph(s)
    edges = docs.filter("doc_id % 10 = 0").select("object_id", F.lit("KB-00000001").alias("target_object"), F.lit("PART_OF").alias("relationship_type"), F.lit("job:1").alias("created_by")).withColumnRenamed("object_id", "source_object")
    one = rebuild.rebuild(docs.filter("doc_id % 3 <> 0").unionByName(chats), pages.filter("page_id % 2 = 0"), entities, edges, _FROM)
    high = _FROM + one["entities"].count()
    second = docs.filter("doc_id % 5 <> 0 and source_id <> 'src1'").unionByName(chats)
    two = rebuild.rebuild(second, pages, one["entities"], one["edges"], high)
    high += two["entities"].count() - one["entities"].count()
    three = rebuild.rebuild(second, pages, two["entities"], two["edges"], high)
    provenance = one["provenance"].unionByName(two["provenance"]).unionByName(three["provenance"])
    return {"entities": three["entities"], "edges": three["edges"], "provenance": provenance}


_GRAPH = f"""{sql.URL}, {sql.OBJ}, ch AS (SELECT DISTINCT conv_id, printf('KB-%08d', conv_id + 50000000) AS object_id FROM conversations), r AS (SELECT page_id, printf('KB-%08d', page_id + 70000000) AS object_id, {sql.REGISTRABLE} AS title FROM u WHERE normalized_url IS NOT NULL),
o1 AS (SELECT * FROM obj WHERE doc_id % 3 <> 0), o2 AS (SELECT * FROM obj WHERE doc_id % 5 <> 0 AND source_id <> 'src1'),
acc AS (SELECT 'Account' AS c, 'acct' || conv_id % 3 AS title FROM ch),
e1 AS (SELECT 'Domain' AS c, title FROM r WHERE page_id % 2 = 0 UNION SELECT 'Workspace', source_id FROM o1 UNION SELECT 'Folder', source_id FROM o1 UNION SELECT 'Account', account_id FROM o1 UNION FROM acc),
e2 AS (SELECT 'Domain' AS c, title FROM r UNION SELECT 'Workspace', source_id FROM o2 UNION SELECT 'Folder', source_id FROM o2 UNION SELECT 'Account', account_id FROM o2 UNION FROM acc),
ids AS (SELECT c, title, row_number() OVER (ORDER BY c, title) + {_FROM} AS n FROM e1 UNION ALL SELECT c, title, row_number() OVER (ORDER BY c, title) + {_FROM} + (SELECT count(*) FROM e1) FROM (FROM e2 EXCEPT FROM e1)),
ti AS (SELECT DISTINCT title FROM ids WHERE c IN ('Domain', 'Workspace') AND length(title) >= 4), txt AS (SELECT object_id, body FROM o2 UNION ALL SELECT object_id, NULL FROM ch),
{sql.mention_ctes('ti', 'txt')},
x AS (SELECT r.object_id AS s, 'Domain' AS c, title, 'HOSTED_AT' AS t, 'rule:domain-from-url' AS b FROM r UNION SELECT object_id, 'Workspace', source_id, 'BELONGS_TO', 'rule:workspace-from-registry' FROM o2 UNION SELECT object_id, 'Folder', source_id, 'STORED_IN', 'rule:folder-from-path' FROM o2
  UNION SELECT object_id, 'Account', 'acct' || conv_id % 3, 'BELONGS_TO', 'rule:account-from-registry' FROM ch
  UNION SELECT object_id, c, title, 'MENTIONS', 'rule:mention-fts' FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY score DESC, object_id) AS k FROM sc) JOIN ids USING (title) WHERE k <= 500 AND c IN ('Domain', 'Workspace')),
ed AS (SELECT s AS source_object, printf('KB-%08d', n) AS target_object, t AS relationship_type, b AS created_by FROM x JOIN ids USING (c, title) UNION ALL SELECT object_id, 'KB-00000001', 'PART_OF', 'job:1' FROM obj WHERE doc_id % 10 = 0)"""


@query("G07_rebuilt_entities", f"WITH {_GRAPH} SELECT printf('KB-%08d', n) AS object_id, c AS entity_class, title, CASE WHEN printf('KB-%08d', n) IN (SELECT target_object FROM ed) THEN 'CURRENT' ELSE 'SUPERSEDED' END AS decay_status, c IN ('Domain', 'Workspace') AND title IN (SELECT title FROM per, tot WHERE per.n > greatest(floor(total * 0.05), 1)) AS saturated FROM ids")
def _(s, d):
    return _rebuilt(s, d)["entities"].select("object_id", "entity_class", "title", "decay_status", "saturated")


@query("G07_rebuilt_edges", f"WITH {_GRAPH} SELECT * FROM ed")
def _(s, d):
    return _rebuilt(s, d)["edges"]


@query("G01_entity_provenance", f"WITH {_GRAPH} SELECT printf('KB-%08d:v01', n) AS version_id, 'graph:' || CASE c WHEN 'Domain' THEN 'domain-from-url' WHEN 'Workspace' THEN 'workspace-from-registry' WHEN 'Folder' THEN 'folder-from-path' ELSE 'account-from-registry' END AS transformation_id FROM ids")
def _(s, d):
    """The rule that made each entity: the provenance of its first version, whichever rebuild that was."""
    return _rebuilt(s, d)["provenance"].filter("version_id like '%:v01'").select("version_id", "transformation_id")
