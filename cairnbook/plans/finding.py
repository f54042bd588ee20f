"""Registered queries that search by position and by meaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnbook.functions import text as tx
from cairnbook.functions.lineage import spread, stored
from cairnbook.functions.stem import stems
from cairnbook.operators import phrases, search, semantic
from cairnbook.plans import sql
from cairnbook.plans.registry import query
from cairnbook.plans.tables import objects, read


@query("R01_phrases", f"WITH d AS (SELECT doc_id AS object_id, {sql.toks('text')} AS ws FROM documents), p AS (SELECT item_id AS query_id, {sql.toks('text')} AS pw FROM benchmark), c AS (SELECT object_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d) SELECT query_id, object_id, CAST(i - 1 AS INTEGER) AS pos FROM c JOIN p ON ws[i] = pw[1] WHERE len(pw) >= 3 AND ws[i:i + len(pw) - 1] = pw")
def _(s, d):
    """Every place where a benchmark text of three words or more stands in a document, word for word."""
    asked = read(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("phrase")).filter(F.size(tx.tokens(F.col("phrase"))) >= 3)
    return phrases.phrase_hits(read(s, d, "documents").select(F.col("doc_id").alias("object_id"), F.col("text").alias("body")), asked)


@query("R01_stemmed_index")
def _(s, d):
    """Postings of stems, titles included: the index that stemmed phrases and searches read."""
    docs = spread(objects(s, d).select("object_id", F.col("source_id").alias("title"), "body"), "object_id")
    return phrases.positions(docs, stemmed=True).groupBy("term", "object_id").agg(F.count("*").alias("tf"), F.min("pos").alias("first"))


@query("E02_stems")
def _(s, d):
    """The stem of each distinct word of all texts."""
    every = read(s, d, "documents").select(F.explode(F.array_distinct(tx.tokens(F.col("text")))).alias("word")).distinct()
    return every.select("word", stems(F.array("word"))[0].alias("stem"))


_SHOWN = f"""d AS (SELECT printf('KB-%08d', doc_id + 1) AS object_id, {sql.toks('text')} AS ws FROM documents),
hp AS (SELECT r.query_id, r.object_id, t.term, i FROM res r JOIN d USING (object_id), LATERAL (SELECT unnest(range(1, len(ws) + 1)) AS i) JOIN q t ON t.term = ws[i] AND t.query_id = r.query_id),
wd AS (SELECT a.query_id, a.object_id, a.i, count(DISTINCT b.term) AS u, count(*) AS n FROM hp a JOIN hp b ON a.query_id = b.query_id AND a.object_id = b.object_id AND b.i BETWEEN a.i AND a.i + 11 GROUP BY 1, 2, 3),
be AS (SELECT query_id, object_id, i FROM (SELECT *, row_number() OVER (PARTITION BY query_id, object_id ORDER BY u DESC, n DESC, i) AS k FROM wd) WHERE k = 1),
st AS (SELECT r.*, ws, coalesce(i, 1) AS i, (SELECT list(term) FROM q WHERE q.query_id = r.query_id) AS ts FROM res r JOIN d USING (object_id) LEFT JOIN be ON be.query_id = r.query_id AND be.object_id = r.object_id)"""


@query("R08_snippets", f"WITH res AS ({sql.HYBRID}), {sql._INDEX}, {_SHOWN} SELECT query_id, object_id, rank, CASE WHEN i > 1 THEN '...' ELSE '' END || array_to_string(list_transform(ws[i:i + 11], lambda w: CASE WHEN list_contains(ts, w) THEN '[' || w || ']' ELSE w END), ' ') || CASE WHEN i + 11 < len(ws) THEN '...' ELSE '' END AS snippet FROM st")
def _(s, d):
    """The results of the hybrid search with the best window of each text."""
    o = objects(s, d).withColumn("modified_at", F.lit(None).cast("timestamp"))
    asked = read(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    sources = o.select(F.col("source_id").alias("object_id"), F.col("source_id").alias("title")).distinct()
    edges = o.select(F.col("object_id").alias("source_object"), F.col("source_id").alias("target_object"))
    found = stored(search.search(o, asked, sources, edges).select("query_id", "object_id", "rank"))
    return phrases.snippets(found, o, search.query_terms(asked)).select("query_id", "object_id", "rank", "snippet")


#: A copy of each vector that is turned a little, more for each of three kinds: cosines of about 0.99, 0.95 and 0.85.
_TURNED = "list_transform(embedding, lambda x, i: CAST(x AS DOUBLE) * (1 + 0.15 * (1 + vec_id % 3) * CASE WHEN i % 2 = 0 THEN 1 ELSE -1 END))"


@query(
    "Z01_semantic_copies",
    f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings UNION ALL SELECT vec_id + 1000000000, {_TURNED} FROM embeddings),
c AS (SELECT a.vec_id AS query_id, b.vec_id AS object_id, round(list_cosine_similarity(a.e, b.e), 6) AS cosine FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0 AND a.vec_id < 1000000000)
SELECT query_id, object_id, cosine FROM c WHERE cosine >= 0.9""",
)
def _(s, d):
    """All vectors and a turned copy of each: what lies near every vector whose id is divisible by 50."""
    e = read(s, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    share = 0.15 * (1 + F.col("vec_id") % 3)
    turned = F.transform("embedding", lambda x, i: x * (1 + share * F.when(i % 2 == 1, 1).otherwise(-1)))  # i from 0 here
    rows = e.unionByName(e.withColumn("embedding", turned).withColumn("vec_id", F.col("vec_id") + 1_000_000_000))
    return semantic.similar_vectors(rows, e.filter("vec_id % 50 = 0"))
