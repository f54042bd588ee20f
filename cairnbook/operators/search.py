"""Ranked search over inverted-index tables: BM25, expansion by feedback, graph candidates and a hybrid score.

Queries come as a table and run together; every step is a join on query_id. The index is three tables: postings
(term, object_id, tf, positions), lengths (object_id, len) and df (term, df)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnbook.functions import text as tx
from cairnbook.functions.lineage import spread, stored
from cairnbook.functions.times import recency_weight

# BM25's usual constants, and the sizes, shares and weights of the specification.
K1, B = 1.2, 0.75
FEEDBACK_DOCS, FEEDBACK_TERMS, FEEDBACK_CHARS, FEEDBACK_MAX_DF = 8, 6, 4000, 0.25
WEIGHTS = {"lexical": 1.0, "expansion": 0.35, "graph": 0.5, "authority": 0.6, "recency": 0.3}


def build_index(docs: DataFrame, body_cap: int | None = None, positions: bool = False) -> dict[str, DataFrame]:
    """docs: object_id, body. Whole texts, or their first body_cap characters. Positions make phrases possible and the
    index larger."""
    body = F.coalesce("body", F.lit(""))
    words = docs.select("object_id", tx.tokens(body if body_cap is None else F.substring(body, 1, body_cap)).alias("words"))
    if positions:
        long = words.select("object_id", F.posexplode("words").alias("pos", "term"))
        postings = long.groupBy("term", "object_id").agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"))
    else:
        postings = words.select("object_id", F.explode("words").alias("term")).groupBy("term", "object_id").agg(F.count("*").alias("tf"))
    lengths = words.select("object_id", F.size("words").alias("len"))
    return {"postings": postings, "lengths": lengths, "df": postings.groupBy("term").agg(F.count("*").alias("df"))}


def query_terms(queries: DataFrame) -> DataFrame:
    """queries: query_id, query. Distinct terms that are no stop words."""
    t = queries.select("query_id", F.explode(F.array_distinct(tx.tokens(F.col("query")))).alias("term"))
    return t.filter(~tx.is_stop_word(F.col("term")))


def counted(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """object_id, len, term, tf of the asked terms, and of each text as a whole under the empty term, which no text has. Made
    in one pass and stored: texts are dealt over all cores, where their terms are counted, and meet the asked terms before
    anything else is shuffled."""
    docs = spread(docs.select("object_id", "body"), "object_id")
    words = docs.select("object_id", tx.tokens(F.coalesce("body", F.lit(""))).alias("words"))
    every = words.select("object_id", F.size("words").alias("len"), F.explode(F.concat("words", F.array(F.lit("")))).alias("term"))
    wanted = stored(asked.select("term").union(asked.sparkSession.createDataFrame([("",)], "term string")).distinct())
    return stored(every.join(wanted, "term", "left_semi").groupBy("object_id", "len", "term").agg(F.count("*").alias("tf")))


def postings_of(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """term, object_id, len, tf of the asked terms only."""
    return counted(docs, asked).filter("term <> ''")


def totals_of(found: DataFrame) -> DataFrame:
    """One row: n_docs, avg_len. found: what `counted` gives; a text that is there twice counts twice."""
    return found.filter("term = ''").agg(F.sum("tf").alias("n_docs"), (F.sum(F.col("tf") * F.col("len")) / F.sum("tf")).alias("avg_len"))


def bm25(docs: DataFrame, terms: DataFrame, pool: int | None = None, require_all: bool = False, found: DataFrame | None = None) -> DataFrame:
    """docs: object_id, body. terms: query_id, term. Returns query_id, object_id, score, matched, rank: the pool best
    documents per query, ties by object_id. found, if given, is what `counted` gives of docs; it may hold more terms. idf
    is floored just above 0."""
    found = counted(docs, terms) if found is None else found
    totals = totals_of(found)
    postings = found.filter("term <> ''").join(terms.select("term").distinct(), "term", "left_semi")
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.greatest(F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    one = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    scored = terms.join(df, "term").join(F.broadcast(totals)).select("query_id", "term", idf.alias("idf"), "avg_len").join(postings, "term")  # totals: one row
    out = scored.groupBy("query_id", "object_id").agg(F.round(F.sum(F.col("idf") * one), 6).alias("score"), F.count("*").alias("matched"))
    if require_all:
        out = out.join(terms.groupBy("query_id").agg(F.count("*").alias("_n")), "query_id").filter("matched = _n").drop("_n")
    return cut(out, pool)


def cut(scores: DataFrame, pool: int | None) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "object_id"))
    ranked = scores.withColumn("rank", rank)
    return ranked if pool is None else ranked.filter(F.col("rank") <= pool)


def feedback_terms(docs: DataFrame, hits: DataFrame, terms: DataFrame, n_docs: int = FEEDBACK_DOCS) -> DataFrame:
    """query_id, term, c: terms of the first characters of the best hits, in two hits at least, no stop words, identifiers
    or terms of the query."""
    best = hits.filter(F.col("rank") <= n_docs).select("query_id", "object_id").join(docs.select("object_id", "body"), "object_id")
    t = F.array_distinct(tx.tokens(F.substring("body", 1, FEEDBACK_CHARS)))
    seen = best.select("query_id", F.explode(t).alias("term")).filter((F.length("term") > 2) & ~tx.is_stop_word(F.col("term")) & ~tx.is_identifier(F.col("term")))
    return seen.groupBy("query_id", "term").agg(F.count("*").alias("c")).filter("c >= 2").join(terms.select("query_id", "term"), ["query_id", "term"], "left_anti")


def rare_terms(seen: DataFrame, postings: DataFrame, totals: DataFrame, n_terms: int = FEEDBACK_TERMS, max_df: float = FEEDBACK_MAX_DF) -> DataFrame:
    """query_id, term, weight: of the feedback terms those that are rare in the corpus (document frequency over whole
    texts), scored hits * ln(N / df)."""
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    scored = seen.join(df, "term").join(F.broadcast(totals.select("n_docs"))).filter(F.col("df") <= F.col("n_docs") * max_df)  # one row
    scored = scored.withColumn("weight", F.round(F.col("c") * F.log(F.col("n_docs") / F.col("df")), 6))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("weight"), F.desc("term")))
    return scored.withColumn("_r", rank).filter(F.col("_r") <= n_terms).select("query_id", "term", "weight")


def expansion_terms(docs: DataFrame, hits: DataFrame, terms: DataFrame) -> DataFrame:
    """query_id, term, weight: what the best hits of a query add to it."""
    seen = stored(feedback_terms(docs, stored(hits), terms))
    found = counted(docs, seen)
    return rare_terms(seen, found.filter("term <> ''"), totals_of(found))


def match_entities(queries: DataFrame, entities: DataFrame, limit: int = 8) -> DataFrame:
    """query_id, object_id, title, exact: live entities whose title has a query term of four or more characters as a
    whole word; exact titles first, at most `limit` per query. Titles are tokenised, so the join is on words.

    An entity among the first of a query is among the first of one of its terms too (the one that it equals, if any): what
    comes before it there comes before it in the query. So a word brings `limit` entities, however many titles have it."""
    t = query_terms(queries).filter(F.length("term") >= 4)
    words = entities.select("object_id", "title", F.explode(F.array_distinct(tx.tokens(F.col("title")))).alias("term")).filter(F.length("term") >= 4).distinct()
    words = words.withColumn("exact", F.lower("title") == F.col("term"))
    first = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("exact"), "object_id", "title"))
    words = words.withColumn("_r", first).filter(F.col("_r") <= limit).drop("_r")
    met = t.join(words, "term").groupBy("query_id", "object_id", "title").agg(F.bool_or("exact").alias("exact"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("exact"), "object_id", "title"))
    return met.withColumn("_r", rank).filter(F.col("_r") <= limit).drop("_r")


def graph_candidates(matched: DataFrame, edges: DataFrame, pool: int) -> DataFrame:
    """query_id, object_id, score: objects by the number of matched entities that they have an edge to."""
    met = matched.select("query_id", F.col("object_id").alias("target_object")).join(edges.select("source_object", "target_object").distinct(), "target_object")
    return cut(met.groupBy("query_id", F.col("source_object").alias("object_id")).agg(F.count("*").cast("double").alias("score")), pool)


def normalised(scores: DataFrame, name: str) -> DataFrame:
    """Scores over the greatest of their query."""
    top = F.max("score").over(Window.partitionBy("query_id"))
    return scores.select("query_id", "object_id", F.when(top > 0, F.col("score") / top).otherwise(0.0).alias(name))


def hybrid_rank(signals: dict[str, DataFrame], objects: DataFrame, limit: int = 20, as_of_year: int | None = None) -> DataFrame:
    """signals: lexical, expansion, graph (query_id, object_id, score; cut to their pools). objects: object_id,
    authority, modified_at. Returns query_id, object_id, score, its components and rank; each component is rounded to
    four places before they are summed. The pools bound what is joined."""
    parts = [normalised(df, name) for name, df in signals.items()]
    met = parts[0]
    for p in parts[1:]:
        met = met.join(p, ["query_id", "object_id"], "full_outer")
    facts = objects.select("object_id", tx.authority_weight(F.col("authority")).alias("_authority"), (recency_weight(F.col("modified_at"), as_of_year) if as_of_year else F.lit(0.0)).alias("_recency"))
    met = met.join(facts, "object_id")
    terms = {name: F.round(WEIGHTS[name] * F.coalesce(name, F.lit(0.0)), 4) for name in signals}
    terms |= {"authority": F.round(WEIGHTS["authority"] * F.col("_authority"), 4), "recency": F.round(WEIGHTS["recency"] * F.col("_recency"), 4)}
    out = met.select("query_id", "object_id", *(c.alias(f"c_{n}") for n, c in terms.items()))
    total = sum((F.col(f"c_{n}") for n in terms), F.lit(0.0))
    out = out.withColumn("score", F.round(total, 4))
    return cut(out, limit)


def search(docs: DataFrame, queries: DataFrame, entities: DataFrame | None = None, edges: DataFrame | None = None, limit: int = 20, expand: bool = True, use_graph: bool = True, as_of_year: int | None = None) -> DataFrame:
    """Hybrid search of a table of queries (query_id, query) over docs (object_id, body, authority, modified_at)."""
    pool = 5 * limit
    terms = query_terms(queries)
    lexical = bm25(docs, terms, pool)
    if expand:
        # the texts are made tokens twice: for the terms of the queries, and for those of the feedback
        lexical = stored(lexical)
        seen = stored(feedback_terms(docs, lexical, terms))
        found = counted(docs, seen)
        more = stored(rare_terms(seen, found.filter("term <> ''"), totals_of(found)))
        signals = {"lexical": lexical, "expansion": bm25(docs, more.select("query_id", "term"), pool, found=found)}
    else:
        signals = {"lexical": lexical}
    if use_graph and entities is not None and edges is not None:
        signals["graph"] = graph_candidates(match_entities(queries, entities), edges, pool)
    return hybrid_rank({name: df.select("query_id", "object_id", "score") for name, df in signals.items()}, docs, limit, as_of_year)
