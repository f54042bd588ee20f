"""Searches over positions: exact phrases, and the best window of a text to show for a query.

Positions are rows (object_id, term, pos). Those of a title lie far before those of the body, so no phrase reaches from
one into the other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnbook.functions import text as tx
from cairnbook.functions.lineage import fixed
from cairnbook.functions.stem import stems

TITLE_AT = -1_000_000
WIDTH = 12


def words(column: Column, stemmed: bool) -> Column:
    return stems(tx.tokens(column)) if stemmed else tx.tokens(column)


def positions(docs: DataFrame, stemmed: bool = False) -> DataFrame:
    """docs: object_id, body, perhaps title. Repeated rows count once."""
    body = docs.select("object_id", F.posexplode(words(F.col("body"), stemmed)).alias("pos", "term"))
    if "title" in docs.columns:
        title = docs.select("object_id", F.posexplode(words(F.col("title"), stemmed)).alias("pos", "term"))
        body = body.unionByName(title.withColumn("pos", F.col("pos") + TITLE_AT))
    return body.select("object_id", "term", "pos")


def phrase_hits(docs: DataFrame, phrases: DataFrame, stemmed: bool = False) -> DataFrame:
    """phrases: query_id, phrase. Every place (query_id, object_id, pos) at which all words of a phrase follow one another;
    stemmed: by their stems. A phrase without words is nowhere.

    Only positions of words that a phrase has are kept. A phrase meets the postings of its rarest word alone; each place
    where that stands asks for the other words at their positions, so a frequent word is looked up, never listed."""
    asked = fixed(phrases.select("query_id", words(F.col("phrase"), stemmed).alias("w")).select("query_id", F.size("w").alias("k"), F.posexplode("w").alias("i", "term")))
    found = fixed(positions(docs, stemmed).join(asked.select("term").distinct(), "term").distinct())
    counts = found.groupBy("term").agg(F.count("*").alias("n"))
    rarest = asked.join(counts, "term").groupBy("query_id", "k").agg(F.min_by(F.struct("i", "term"), F.struct("n", "i")).alias("r")).select("query_id", "k", "r.*")
    starts = rarest.join(found, "term").select("query_id", "k", "object_id", (F.col("pos") - F.col("i")).alias("at"))
    wanted = starts.join(asked.drop("k"), "query_id").select("query_id", "k", "object_id", "at", "term", (F.col("at") + F.col("i")).alias("pos"))
    met = wanted.join(found, ["object_id", "pos", "term"]).groupBy("query_id", "k", "object_id", "at").agg(F.count("*").alias("n"))
    return met.filter("n = k").select("query_id", "object_id", F.col("at").alias("pos"))


def snippets(results: DataFrame, docs: DataFrame, terms: DataFrame, width: int = WIDTH, stemmed: bool = False) -> DataFrame:
    """results: query_id, object_id, ... with `snippet` added: the `width` tokens of the body that hold the most distinct
    terms of the query, then the most of any, then the first; terms in brackets, dots where the body goes on. terms:
    query_id, term (stems, if stemmed). Without a term in the body: its first tokens.

    Only the texts of results are tokenised, each once; a window over the positions of the terms finds the best start."""
    kept = docs.select("object_id", "body").join(results.select("object_id").distinct(), "object_id").dropDuplicates(["object_id"])
    kept = fixed(kept.select("object_id", tx.tokens(F.col("body")).alias("_shown")).withColumn("_terms", stems("_shown") if stemmed else F.col("_shown")))
    asked = terms.groupBy("query_id").agg(F.collect_set("term").alias("_asked"))
    pairs = results.select("query_id", "object_id").distinct().join(asked, "query_id", "left").join(kept, "object_id")
    hits = pairs.select("query_id", "object_id", "_asked", F.posexplode("_terms").alias("pos", "term")).filter(F.array_contains("_asked", F.col("term"))).drop("_asked")
    ahead = Window.partitionBy("query_id", "object_id").orderBy("pos").rangeBetween(0, width - 1)
    scored = hits.select("query_id", "object_id", "pos", F.size(F.collect_set("term").over(ahead)).alias("d"), F.count("*").over(ahead).alias("n"))
    best = scored.groupBy("query_id", "object_id").agg(F.min_by("pos", F.struct(-F.col("d"), -F.col("n"), F.col("pos"))).alias("_at"))
    shown = pairs.join(best, ["query_id", "object_id"], "left").withColumn("_at", F.coalesce("_at", F.lit(0)))
    marked = F.zip_with(F.slice("_shown", F.col("_at") + 1, width), F.slice("_terms", F.col("_at") + 1, width), lambda w, t: F.when(F.array_contains("_asked", t), F.concat(F.lit("["), w, F.lit("]"))).otherwise(w))
    cut = F.concat(F.when(F.col("_at") > 0, "...").otherwise(""), F.array_join(marked, " "), F.when(F.col("_at") + width < F.size("_shown"), "...").otherwise(""))
    return results.join(shown.select("query_id", "object_id", cut.alias("snippet")), ["query_id", "object_id"], "left")
