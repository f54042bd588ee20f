"""MinHash near-duplicate detection: many universal hash minima with banding, signature verification, and connected
components by alternating large-star and small-star.

Plan: texts are read once for their shingle-set keys, minima and band hashes. Copies of one set are one class, and its
least document stands for it. In each band bucket all members are paired with its least and its greatest member only;
signatures, then full shingle sets, confirm the pairs. Members of a bucket that these links leave in different
components go through an exact prefix filter: two sets of the asked similarity share one of their rarest shingles, a
fifth of each and one more, so documents that only share a common passage drop out. What still shares such a shingle is
paired with the least and greatest of its holders in turn, and what that leaves apart is compared in packed blocks. So
no candidate of the banding is lost, and neither a group of near copies nor a common passage becomes rows for all its
pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnbook.llm.components import connected_components
from cairnbook.llm.shared import bounded, materialise, mix, pieces, salted_left_join, text_or_empty, word_hashes

#: 36 bands of 4 minima: a pair at similarity 0.8 is missed with probability (1 - 0.8**4)**36 < 1e-8.
BANDS, ROWS = 36, 4
SHINGLE_WORDS = 5
PERCENT = 80
#: A signature keeps the low PLANES bits of each minimum, one bit plane after the other, in longs of LANE bits.
PLANES, LANE = 4, 48
LONGS = PLANES * BANDS * ROWS // LANE
#: Documents, and shingles, of a block of documents that are compared with another block, about.
BLOCK_DOCS, BLOCK_SHINGLES = 256, 80_000
#: Signatures drop a pair whose estimate is below the threshold by SLACK, five standard errors at 0.8.
SLACK = 0.175

_SEEDS = mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
#: Universal hashing of 32-bit keys by multiply-add-shift with 64-bit odd factors.
_A, _B = _SEEDS[: BANDS * ROWS] | np.uint64(1), _SEEDS[BANDS * ROWS:]


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text with fewer words than a shingle has its whole sequence
    as the only one, a text without words none."""
    words, ends = word_hashes(texts, fold_case=True)
    for start, stop in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        own = words[start:stop]
        k = min(size, len(own))
        if not k:
            yield own
            continue
        joined = np.zeros(len(own) - k + 1, np.uint64)
        for i in range(k):
            joined = mix(joined + own[i:len(own) - k + 1 + i])
        joined.sort()
        keep = np.ones(len(joined), bool)
        np.not_equal(joined[1:], joined[:-1], out=keep[1:])
        yield joined[keep]


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of each hash function over the set."""
    keys, least = shingles >> np.uint64(32), None
    for at in range(0, len(keys), 2048):
        values = (keys[at:at + 2048, None] * _A + _B) >> np.uint64(32)
        low = values.min(axis=0)
        least = low if least is None else np.minimum(least, low)
    return least


def _sign(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            n = batch.num_rows
            counts, key1, key2 = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            least = np.zeros((n, BANDS * ROWS), np.uint64)
            for i, own in enumerate(shingle_sets(batch.column("text"), size)):
                counts[i] = len(own)
                if len(own):
                    key1[i], key2[i] = _keys(own)
                    least[i] = minima(own)
            bands = np.arange(BANDS, dtype=np.uint64) + np.zeros((n, 1), np.uint64)  # the band is part of its key
            for r in range(ROWS):
                bands = mix(bands + least[:, r::ROWS])
            lanes = np.concatenate([least.reshape(n, -1, LANE) >> np.uint64(p) & np.uint64(1) for p in range(PLANES)], axis=1)
            sig = (lanes << np.arange(LANE, dtype=np.uint64)).sum(axis=2, dtype=np.uint64)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel().view(np.int64))) for x in (bands, sig)]
            arrays = [batch.column("doc_id"), pa.array(counts), pa.array(key1.view(np.int64)), pa.array(key2.view(np.int64)), *lists]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_shingles", "key1", "key2", "bands", "signature"])

    return run


def _keys(own: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """Two 64-bit sums that tell sets apart."""
    return own.sum(dtype=np.uint64), mix(own + np.uint64(99)).sum(dtype=np.uint64)


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            sets = list(shingle_sets(batch.column("text"), size))
            keys = np.array([_keys(x) for x in sets], np.uint64).reshape(-1, 2).view(np.int64)
            arrays = [batch.column("doc_id"), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array([x.tobytes() for x in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "key1", "key2", "shingles"])

    return run


def _likely(a: str, b: str, size_a: str, size_b: str, percent: int) -> Column:
    """Whether the signatures (columns a, b: arrays of LONGS longs) and set sizes allow the similarity: sizes exactly,
    the share of equal minima up to SLACK. Low bits of different minima agree once in 2**PLANES."""
    lanes = BANDS * ROWS // LANE
    differ = F.lit(0)
    for lane in range(lanes):
        bits = None
        for p in range(PLANES):
            x = F.col(a)[p * lanes + lane].bitwiseXOR(F.col(b)[p * lanes + lane])
            bits = x if bits is None else bits.bitwiseOR(x)
        differ = differ + F.bit_count(bits)
    chance = 2.0**-PLANES
    least = chance + (1 - chance) * (percent / 100 - SLACK)
    sizes = 100 * F.least(size_a, size_b) >= percent * F.greatest(size_a, size_b)
    return sizes & (differ <= int((1 - least) * BANDS * ROWS))


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("shingles_a"), batch.column("shingles_b"), strict=True)):
                p, q = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = np.sort(np.concatenate([p, q]))
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                good[i] = 100 * common >= percent * (len(p) + len(q) - common)
            yield batch.select(["a", "b"]).filter(pa.array(good))

    return run


def _with_both(pairs: DataFrame, side: DataFrame, values: list[str]) -> DataFrame:
    """Brings the values of each end of the pairs; the side has one row per document."""
    for end in ("a", "b"):
        one = side.select(F.col("doc_id").alias(f"_{end}"), *(F.col(v).alias(f"{v}_{end}") for v in values))
        pairs = pairs.join(one, pairs[end] == one[f"_{end}"]).drop(f"_{end}")
    return pairs


def _set_table(docs: DataFrame, stands: DataFrame, met: DataFrame, shingle_words: int, name: str) -> DataFrame:
    """The shingle sets of the documents in met (doc_id); only their texts are read again. Where rows share a doc_id,
    the set is that of the text whose signature stands."""
    # the ids grow with the documents: they are never broadcast, however few they are here
    ids = stands.select("doc_id", F.col("key1").alias("_k1"), F.col("key2").alias("_k2")).join(met.select("doc_id").distinct(), "doc_id", "left_semi")
    texts = docs.join(ids.hint("merge"), "doc_id").select("doc_id", "_k1", "_k2", text_or_empty().alias("text"))
    sets = texts.select("doc_id", "text").mapInArrow(_sets(shingle_words), "doc_id long, key1 long, key2 long, shingles binary")
    repeated = stands.filter("rows > 1").select("doc_id").distinct()
    if repeated.isEmpty():
        return materialise(sets.select("doc_id", "shingles"), name)
    own = sets.join(ids, "doc_id").filter("key1 = _k1 and key2 = _k2")
    return materialise(own.select("doc_id", "shingles").dropDuplicates(["doc_id"]), name)


def _confirmed(likely: DataFrame, sets: DataFrame, percent: int, name: str) -> DataFrame:
    """The pairs that their full sets allow."""
    return materialise(_with_both(likely, sets, ["shingles"]).mapInArrow(_confirm(percent), "a long, b long"), name)


def _prefixes(percent: int):
    """Of each document the rarest shingles that a similar one must share: (percent of its n, rounded up) - 1 shingles
    stay outside. Shingles that no other torn document has come first and have no partner."""
    outside = F.ceil(F.col("n_shingles") * percent / 100) - 1
    return F.expr("array_sort(shared)"), F.size("shared") - outside


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(batch.num_rows):
            own = np.frombuffer(batch.column("shingles")[at].as_py(), np.int64)
            doc = np.full(len(own), batch.column("doc_id")[at].as_py(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(own)], names=["doc_id", "token"])


def _prefix_posts(torn: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """torn: doc_id, component, n_shingles. Returns doc_id, component, n_shingles, token for the prefix shingles that
    another torn document has. Any order of shingles is right; rare ones first leave the fewest candidates."""
    own = sets.join(torn.select("doc_id").hint("merge"), "doc_id", "left_semi")
    tokens = materialise(own.mapInArrow(_tokens, "doc_id long, token long"), "torn-tokens")
    common = tokens.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    # narrow rows; a shingle of a common passage is a hot key, which adaptive execution splits
    shared = tokens.join(common.hint("merge"), "token").groupBy("doc_id").agg(F.collect_list(F.struct("df", "token")).alias("shared"))
    order, left = _prefixes(percent)
    posts = shared.join(torn, "doc_id").filter(left > 0).select("doc_id", "component", "n_shingles", F.explode(F.slice(order, F.lit(1), left.cast("int"))).alias("t"))
    return posts.select("doc_id", "component", "n_shingles", "t.token")


def _fits(percent: int) -> Column:
    return 100 * F.least("n_shingles_a", "n_shingles_b") >= percent * F.greatest("n_shingles_a", "n_shingles_b")


def _torn_stars(posts: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between holders of one token and its least and greatest holder, of another component."""
    ends = posts.groupBy("token").agg(*(f(F.struct("doc_id", "component", "n_shingles")).alias(k) for k, f in (("low", F.min), ("high", F.max))), F.min("component").alias("c1"), F.max("component").alias("c2"))
    met = posts.join(ends.filter("c1 < c2").drop("c1", "c2"), "token")
    one = F.struct("doc_id", "component", "n_shingles")
    pair = F.explode(F.array(F.struct(one.alias("x"), F.col("low").alias("y")), F.struct(F.col("high").alias("x"), one.alias("y"))))
    pairs = met.select(pair.alias("p")).filter("p.x.component <> p.y.component")
    pairs = pairs.select(F.col("p.x.doc_id").alias("a"), F.col("p.y.doc_id").alias("b"), F.col("p.x.n_shingles").alias("n_shingles_a"), F.col("p.y.n_shingles").alias("n_shingles_b"))
    likely = materialise(pairs.filter(_fits(percent)).select("a", "b").distinct(), "torn-stars")
    return _confirmed(likely, sets, percent, "torn-star-links")


def _cross(percent: int):
    """Links between the documents of two packed blocks, or inside one: shingles in common are counted for all at
    once."""

    def run(table: pa.Table) -> pa.Table:
        packed = table.to_pylist()
        ids, comps, sets = ([np.array(x[c], np.int64) for x in packed] if c != "shingles" else [[np.frombuffer(y, np.uint64) for y in x[c]] for x in packed] for c in ("ids", "components", "shingles"))
        mine, other = 0, len(packed) - 1
        sizes = np.array([len(x) for x in sets[other]])
        tokens, owner = np.concatenate(sets[other]), np.repeat(np.arange(len(sizes)), sizes)
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
        out_a, out_b = [], []
        for i, own in enumerate(sets[mine]):
            apart = comps[other] != comps[mine][i]
            fits = apart & (100 * np.minimum(sizes, len(own)) >= percent * np.maximum(sizes, len(own)))
            if not fits.any():
                continue
            low, high = np.searchsorted(tokens, own, "left"), np.searchsorted(tokens, own, "right")
            n = high - low
            at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
            common = np.bincount(owner[at], minlength=len(sizes))
            found = ids[other][fits & (100 * common >= percent * (len(own) + sizes - common))]
            out_a.append(np.maximum(found, ids[mine][i]))
            out_b.append(np.minimum(found, ids[mine][i]))
        none = [np.zeros(0, np.int64)]
        return pa.table({"a": pa.array(np.concatenate(out_a or none), pa.int64()), "b": pa.array(np.concatenate(out_b or none), pa.int64())})

    return run


def _torn_blocks(posts: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between different components among the holders of one token. Holders form blocks of about BLOCK_DOCS
    (fewer long ones) that first met at the same token; a block is one packed row, so a pair of blocks that share a
    token costs two rows, and pairs of documents never become rows."""
    homes = posts.groupBy("doc_id").agg(F.min("token").alias("home"), F.first("component").alias("component"), F.first("n_shingles").alias("n_shingles"))
    counts = homes.groupBy("home").agg(F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).alias("blocks"))
    homes = salted_left_join(homes, counts, ["home"])
    block = F.struct("home", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).alias("part"))
    homes = materialise(homes.select("doc_id", "component", block.alias("block")), "torn-blocks")
    inside = materialise(posts.select("token", "doc_id").join(homes, "doc_id").groupBy("token", "block").agg(F.min("component").alias("c1"), F.max("component").alias("c2")), "torn-met")
    first, second = (inside.select("token", F.col("block").alias(f"block{k}"), F.col("c1").alias(f"c1{k}"), F.col("c2").alias(f"c2{k}")) for k in "ab")
    differ = (F.col("c1a") != F.col("c2a")) | (F.col("c1b") != F.col("c2b")) | (F.col("c1a") != F.col("c1b"))
    met = first.join(second, ["token"]).filter((F.col("blocka") <= F.col("blockb")) & differ).select("blocka", "blockb").distinct()
    met = materialise(met, "torn-pairs")
    sides = met.select(F.explode(F.array_distinct(F.array("blocka", "blockb"))).alias("block"), F.struct("blocka", "blockb").alias("pair"))
    packed = homes.join(sets, "doc_id").groupBy("block").agg(F.collect_list(F.struct("doc_id", "component", "shingles")).alias("rows"))
    packed = packed.select("block", F.col("rows.doc_id").alias("ids"), F.col("rows.component").alias("components"), F.col("rows.shingles").alias("shingles"))
    return sides.join(packed, "block").drop("block").groupBy("pair").applyInArrow(_cross(percent), "a long, b long").distinct()


def _relabelled(posts: DataFrame, parts: DataFrame) -> DataFrame:
    """posts with the components of parts (node, component), where it has the old component as a node."""
    new = parts.select(F.col("node").alias("_node"), F.col("component").alias("_new"))
    return posts.join(new, posts["component"] == new["_node"], "left").withColumn("component", F.coalesce("_new", "component")).drop("_node", "_new")


def _torn_links(torn: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links that join different components among the torn documents (doc_id, component, n_shingles)."""
    posts = materialise(_prefix_posts(torn, sets, percent), "torn-posts")
    stars = _torn_stars(posts, sets, percent)
    ids = posts.select("doc_id", "component").distinct()
    ends = [ids.select(F.col("doc_id").alias(k), F.col("component").alias(f"component_{k}")) for k in "ab"]
    joined = stars.join(ends[0], "a").join(ends[1], "b").select(F.col("component_a").alias("a"), F.col("component_b").alias("b"))
    posts = _relabelled(posts, connected_components(joined))
    still = posts.groupBy("token").agg(F.min("component").alias("c1"), F.max("component").alias("c2"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("c1 < c2")
    # the least and greatest holders were tried with all others
    posts = posts.join(still.select("token", "low", "high"), "token").filter("doc_id <> low and doc_id <> high").drop("low", "high")
    return stars.unionByName(_torn_blocks(materialise(posts, "torn-rest"), sets, percent))


def near_duplicates(docs: DataFrame, key: str = "doc_id", shingle_words: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """docs: key (integer), text. Returns per row: key, n_shingles, component_id, kept.

    Words are runs of anything but ASCII white space, A-Z lower-cased. Two texts are linked if their sets of
    shingle_words-word shingles have a Jaccard similarity of percent/100 or more. component_id is the least key that is
    reachable, itself included; kept marks that row. Null, empty and wordless texts have no shingles and no links.
    Repeated rows share their class. Keys identify texts: where rows share a key but not a text, they are one node and
    one of the texts stands for it. A null key takes no part: component_id null, kept true. Further columns are ignored."""
    docs = bounded(docs.select(F.col(key).cast("long").alias("doc_id"), "text"))
    signed = materialise(docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(_sign(shingle_words), "doc_id long, n_shingles long, key1 long, key2 long, bands array<long>, signature array<long>"), "minhash")
    shape = ["n_shingles", "key1", "key2"]
    some = signed.filter("n_shingles > 0 and doc_id is not null")
    classes = materialise(some.groupBy(*shape).agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")), "minhash-classes")
    # one row per class, of the least class where a doc_id has several: the only place where a signature is read from
    picks = classes.groupBy("first").agg(F.min(F.struct("key1", "key2", "n_shingles")).alias("pick"), F.sum("copies").alias("rows"))
    picks = picks.select(F.col("first").alias("doc_id"), *[F.col(f"pick.{c}").alias(f"_{c}") for c in shape], "rows")
    stands = some.join(picks, "doc_id").filter(" and ".join(f"{c} = _{c}" for c in shape))
    stands = materialise(stands.select("doc_id", *shape, "bands", "signature", "rows").dropDuplicates(["doc_id"]), "minhash-stands")
    banded = stands.select("doc_id", F.explode("bands").alias("bucket"))
    buckets = banded.groupBy("bucket").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high")
    # few documents share a bucket with another one; from here on only those rows are read
    met = materialise(banded.join(buckets, "bucket"), "minhash-met")
    stars = met.select(F.explode(F.array(F.struct(F.col("doc_id").alias("a"), F.col("low").alias("b")), F.struct(F.col("high").alias("a"), F.col("doc_id").alias("b")))).alias("p")).select("p.a", "p.b")
    stars = stars.filter("a > b").distinct()
    facts = ["signature", "n_shingles"]
    fits = _likely("signature_a", "signature_b", "n_shingles_a", "n_shingles_b", percent)
    likely = materialise(_with_both(stars, stands, facts).filter(fits).select("a", "b"), "minhash-stars")
    # one reading of texts serves both confirmations: it takes all that share a bucket
    sets = _set_table(docs, stands, met, shingle_words, "minhash-sets")
    links = _confirmed(likely, sets, percent, "stars-links")
    parts = materialise(connected_components(links), "minhash-parts")
    # buckets whose members are still apart: the pairs between their components that no star tried
    apart = salted_left_join(met, parts.withColumnRenamed("node", "doc_id"), ["doc_id"]).withColumn("component", F.coalesce("component", "doc_id"))
    inner = apart.filter("doc_id <> low and doc_id <> high")  # the others were tried with all members
    torn = inner.groupBy("bucket").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).filter("c1 < c2").select("bucket")
    left = inner.join(torn, "bucket", "left_semi").select("doc_id", "component").distinct()
    left = materialise(left.join(stands.select("doc_id", "n_shingles"), "doc_id"), "minhash-torn")
    more = _torn_links(left, sets, percent)
    whole = materialise(connected_components(parts.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)), "minhash-whole")
    copied = classes.filter("copies > 1").select(*shape, "first")
    out = salted_left_join(signed.select("doc_id", *shape), copied, shape).withColumn("first", F.coalesce("first", "doc_id"))
    out = salted_left_join(out, whole.select(F.col("node").alias("first"), F.col("component").alias("component_id")), ["first"])
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "first"))
    return out.select(F.col("doc_id").alias(key), "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op4_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle_words=2)
