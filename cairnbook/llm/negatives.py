"""Hard negatives by threshold joins in the manner of L2AP.

Rows are packed into blocks. The anchors meet all rows in cells, each a bucket of anchors against a group of blocks. In a
cell every block gets an index of its dimensions, the strongest first, that omits the tail of a row where the norms of
the tails bound what it can add to any score below the threshold. Partial scores grow dimension by dimension; a pair ends
when the norms of what remains can't lift it to its anchor's threshold, and what is left gets the omitted part added. An
anchor whose windows aren't full starts with a high threshold that is lowered until they are, or down to the window's
end; from then on only what can enter a full window is asked for. Spark merges the windows of all cells.

Scale: two rounds, one for positives, one for negatives in the windows that these give. A cell is bounded on both sides
whatever the labels are, so neither a frequent label nor a frequent vector makes one task large; a cell returns no more
than its anchors' windows hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnbook.llm.shared import materialise

#: Rows of a block, blocks of a group, anchors of a bucket; a cell holds a group and a bucket.
BLOCK, GROUP, BUCKET = 4096, 64, 2048
#: Dimensions between two prunings; anchors whose partial scores are held at once; pairs that are completed at once.
STEP, TILE, PAIRS = 16, 256, 1 << 15
#: The shares of the greatest possible score at which unfilled windows are tried, one after another.
LADDER = (0.75, 0.6, 0.45, 0.3, 0.15, 0.0)
SCALE = 256


class Index:
    """The rows of a block with their dimensions by energy, for scores above a threshold."""

    def __init__(self, x: np.ndarray):
        self.order = np.argsort(-(x.astype(float) ** 2).sum(0), kind="stable")
        self.x = x[:, self.order].astype(float)
        self.tails = tails(self.x)
        self.longest = float(self.tails[:, 0].max(initial=0))

    def search(self, anchors: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, row, score) of all pairs with least <= score <= most of the anchor; both are whole numbers or
        infinite."""
        out = [self._tile(anchors[i : i + TILE], least[i : i + TILE], most[i : i + TILE]) for i in range(0, len(anchors), TILE)]
        shifted = [(a + k * TILE, r, s) for k, (a, r, s) in enumerate(out)]
        return tuple(np.concatenate([s[k] for s in shifted]) if shifted else np.zeros(0, np.int64) for k in range(3))

    def _tile(self, anchors, least, most):
        n, dims = self.x.shape
        a = anchors[:, self.order].astype(float)
        tail = tails(a)
        slack = 1e-6 + 1e-9 * self.longest * float(tail[:, 0].max(initial=0))
        # the index: a row's dimensions up to the first whose tail can add no more than any threshold asks
        lowest = float(least.min(initial=np.inf))
        needless = self.tails * tail.max(0, initial=0) < lowest - slack
        cut = np.where(needless.any(1), needless.argmax(1), dims)
        rows = np.argsort(-cut, kind="stable")
        cut = cut[rows]
        x = np.where(np.arange(dims) < cut[:, None], self.x[rows], 0.0)
        partial = np.zeros((len(a), n))
        alive = None
        for k in range(0, dims, STEP):
            listed = int(np.searchsorted(-cut, -k))  # rows that index a dimension from k on come first
            if listed:
                partial[:, :listed] += a[:, k : k + STEP] @ x[:listed, k : k + STEP].T
            reached = np.minimum(cut, k + STEP)
            rest = tail[:, reached] * self.tails[rows, reached]
            alive = (partial + rest >= least[:, None] - slack) & (partial - rest <= most[:, None] + slack)
            keep = alive.any(0)
            if 2 * keep.sum() < len(rows):
                rows, cut, x, partial, alive = rows[keep], cut[keep], x[keep], partial[:, keep], alive[:, keep]
            if not len(rows):
                break
        if alive is None or not len(rows):
            return (np.zeros(0, np.int64),) * 3
        i, j = np.nonzero(alive)
        score = np.empty(len(i))
        after = np.arange(dims)
        for p in range(0, len(i), PAIRS):
            s, t = i[p : p + PAIRS], j[p : p + PAIRS]
            omitted = np.where(after >= cut[t][:, None], self.x[rows[t]], 0.0)
            score[p : p + PAIRS] = partial[s, t] + np.einsum("ij,ij->i", a[s], omitted)
        fit = (score >= least[i]) & (score <= most[i])
        return i[fit], rows[j[fit]], score[fit].astype(np.int64)


def tails(x: np.ndarray) -> np.ndarray:
    """Norms of the dimensions from k on, for k from 0 to all."""
    squares = np.cumsum((x**2)[:, ::-1], 1)[:, ::-1]
    return np.sqrt(np.concatenate([squares, np.zeros((len(x), 1))], 1))


class Windows:
    """The best `size` candidates of each of many windows [low, high] on scores; a window belongs to an anchor."""

    def __init__(self, anchors: int, owners: np.ndarray, low: np.ndarray, high: np.ndarray, size: int):
        self.owners, self.low, self.high, self.size = owners, low, high, size
        self.window = np.zeros(0, np.int64)
        self.score = np.zeros(0, np.int64)
        self.row = np.zeros(0, np.int64)
        self.first = np.searchsorted(owners, np.arange(anchors + 1))

    def add(self, anchor: np.ndarray, row: np.ndarray, score: np.ndarray) -> None:
        """Takes pairs not seen before; a window keeps its best, higher scores first, ties by smaller row id."""
        widest = int(np.diff(self.first).max(initial=0))
        for k in range(widest):  # the k-th window of each pair's anchor
            at = self.first[anchor] + k
            has = at < self.first[anchor + 1]
            w, r, s = at[has], row[has], score[has]
            inside = (s >= self.low[w]) & (s <= self.high[w])
            self.window, self.row, self.score = (np.concatenate(x) for x in ((self.window, w[inside]), (self.row, r[inside]), (self.score, s[inside])))
        order = np.lexsort((self.row, -self.score, self.window))
        w = self.window[order]
        rank = np.arange(len(w)) - np.searchsorted(w, w)
        best = order[rank < self.size]
        self.window, self.row, self.score = self.window[best], self.row[best], self.score[best]

    def floors(self) -> tuple[np.ndarray, np.ndarray]:
        """For each anchor: the least score that can still enter one of its windows, and whether all are full."""
        n, anchors = np.bincount(self.window, minlength=len(self.low)), len(self.first) - 1
        worst = np.full(len(self.low), np.iinfo(np.int64).max)
        np.minimum.at(worst, self.window, self.score)
        full = n >= self.size
        least, ready = np.full(anchors, np.inf), np.ones(anchors, bool)
        np.minimum.at(least, self.owners, np.where(full, worst, self.low))
        np.logical_and.at(ready, self.owners, full)
        return least, ready


def fill(windows: Windows, anchors: np.ndarray, index: Index, partner, ids: np.ndarray, mine: np.ndarray) -> None:
    """One block, for the anchors numbered in mine: thresholds of anchors with unfilled windows go down the ladder, those
    of the others stand at the least score that still enters a window. partner tells of (anchor, row) numbers which pairs
    count."""
    most = np.full(len(anchors), -np.inf)
    np.maximum.at(most, windows.owners, windows.high)
    top = np.minimum(np.sqrt((anchors.astype(float) ** 2).sum(1)) * index.longest + 1, most)
    for share in (*LADDER, -np.inf):
        floor, ready = windows.floors()
        asked = mine[most[mine] >= floor[mine]]
        if not len(asked):
            return
        step = np.ceil(np.minimum(top * share, top)) if share > -np.inf else np.full(len(anchors), -np.inf)
        least = np.where(ready, floor, np.maximum(floor, step))[asked]
        a, r, s = index.search(anchors[asked], least, most[asked])
        a = asked[a]
        good = partner(a, r)
        windows.add(a[good], ids[r[good]], s[good])
        most[asked] = least - 1  # what lies above has been seen


def _dense(flat: np.ndarray, rows: int, dims: int) -> np.ndarray:
    """rows of a block, with zeros up to `dims` dimensions."""
    x = flat.reshape(rows, -1) if rows else np.zeros((0, 0))
    return np.pad(x, ((0, 0), (0, dims - x.shape[1])))


_LONGS = T.ArrayType(T.LongType())
_BLOCK = T.StructType().add("_block", "long").add("ids", _LONGS).add("labels", _LONGS).add("dims", T.IntegerType()).add("values", T.ArrayType(T.IntegerType()))


def pack(rows: DataFrame) -> DataFrame:
    """Blocks of up to BLOCK rows (vec_id, label, values) as they lie in their partitions; shorter vectors end in zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                lists = part.column("values")
                sizes = lists.value_lengths().to_numpy()
                dims = int(sizes.max(initial=0))
                x = np.zeros((part.num_rows, dims), np.int32)
                x[np.arange(dims) < sizes[:, None]] = lists.flatten().to_numpy()
                columns = [[block], [part.column("vec_id").to_numpy()], [part.column("label").to_numpy()], [dims], [x.ravel()]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.list_(pa.int32())), strict=True)], names=_BLOCK.names)
                block += 1

    return rows.select("vec_id", "label", "values").mapInArrow(run, _BLOCK)


def _cells(blocks: DataFrame, anchors: DataFrame, search, schema: str) -> DataFrame:
    """search(blocks, anchors) -> table in every cell, a group of blocks against a bucket of anchors: each block goes to
    all buckets and each anchor to all groups, so every pair meets once."""
    count = blocks.count()
    groups = max(-(-count // GROUP), min(count, blocks.sparkSession.sparkContext.defaultParallelism), 1)
    buckets = max(-(-anchors.count() // BUCKET), 1)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = blocks.withColumn("_group", F.pmod(F.xxhash64("_block"), F.lit(groups)).cast("int")).withColumn("_bucket", every(buckets))
    right = anchors.withColumn("_bucket", F.pmod(F.col("_anchor"), F.lit(buckets)).cast("int")).withColumn("_group", every(groups))
    return left.groupBy("_group", "_bucket").cogroup(right.groupBy("_group", "_bucket")).applyInArrow(search, schema)


def _vectors(anchors: pa.Table, dims: int) -> np.ndarray:
    return np.stack([np.pad(v.values.to_numpy(), (0, dims - len(v))) for v in anchors.column("values")])


def _blocks(table: pa.Table, dims: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for k in range(table.num_rows):
        ids, labels, values = (table.column(c)[k].values.to_numpy() for c in ("ids", "labels", "values"))
        yield ids, labels, _dense(values, len(ids), dims)


def _dims(blocks: pa.Table, anchors: pa.Table) -> int:
    return max(int(np.max(blocks.column("dims"), initial=0)), int(np.max(anchors.column("values").combine_chunks().value_lengths(), initial=0)))


def _positives(size: int):
    def search(blocks: pa.Table, anchors: pa.Table) -> pa.Table:
        ids, labels = anchors.column("vec_id").to_numpy(), anchors.column("label").to_numpy()
        n = len(ids)
        free = np.full(n, 1 << 61)
        windows = Windows(n, np.arange(n), -free, free, size)
        if n and blocks.num_rows:
            dims = _dims(blocks, anchors)
            vectors = _vectors(anchors, dims)
            for row_ids, row_labels, x in _blocks(blocks, dims):
                for label in np.intersect1d(labels, row_labels):
                    mine, rows = np.flatnonzero(labels == label), np.flatnonzero(row_labels == label)
                    fill(windows, vectors, Index(x[rows]), lambda a, r, rows=rows, row_ids=row_ids: ids[a] != row_ids[rows[r]], row_ids[rows], mine)
        at = windows.window
        return pa.table({"vec_id": ids[at], "_anchor": anchors.column("_anchor").to_numpy()[at], "positive_id": windows.row, "positive_score": windows.score})

    return search


def _negatives(size: int, least_percent: int, most_percent: int):
    def search(blocks: pa.Table, anchors: pa.Table) -> pa.Table:
        ids, labels = anchors.column("vec_id").to_numpy(), anchors.column("label").to_numpy()
        positives = anchors.column("positives").to_pylist()
        owners = np.repeat(np.arange(len(ids)), [len(p) for p in positives])
        each = [x for p in positives for x in p]
        scores = np.array([x["positive_score"] for x in each], np.int64)
        windows = Windows(len(ids), owners, -(-least_percent * scores // 100), most_percent * scores // 100, size)
        if len(ids) and blocks.num_rows:
            dims = _dims(blocks, anchors)
            vectors = _vectors(anchors, dims)
            for row_ids, row_labels, x in _blocks(blocks, dims):
                fill(windows, vectors, Index(x), lambda a, r, row_labels=row_labels: labels[a] != row_labels[r], row_ids, np.arange(len(ids)))
        at = windows.window
        of = [each[w] for w in at]
        return pa.table({
            "anchor_id": ids[owners[at]] if len(at) else np.zeros(0, np.int64), "_anchor": anchors.column("_anchor").to_numpy()[owners[at]] if len(at) else np.zeros(0, np.int64),
            "positive_rank": pa.array([p["positive_rank"] for p in of], pa.int32()), "positive_id": pa.array([p["positive_id"] for p in of], pa.int64()),
            "positive_score": pa.array([p["positive_score"] for p in of], pa.int64()), "negative_id": windows.row, "negative_score": windows.score,
        })

    return search


def _first(rows: DataFrame, of: list[str], score: str, by: str, size: int, rank: str) -> DataFrame:
    order = Window.partitionBy(*of).orderBy(F.desc(score), by)
    return rows.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) <= size)


def whole_numbers(vector: str, scale: int = SCALE, limit: int = 1 << 20) -> Column:
    """Components times `scale`, rounded down, as integers; beyond +-limit they are the limit, so that scores of vectors of
    up to 8192 dimensions are exact. Null if the vector or a component is null or not finite."""
    x = F.col(vector).cast("array<double>")
    fine = F.forall(x, lambda v: F.coalesce(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")), F.lit(False)))
    whole = F.transform(x, lambda v: F.floor(F.greatest(F.least(v * scale, F.lit(float(limit))), F.lit(-float(limit)))).cast("int"))
    return F.when(fine, whole)


def hard_negatives(rows: DataFrame, positives: int = 5, negatives: int = 10, least_percent: int = 30, most_percent: int = 90) -> DataFrame:
    """rows: vec_id, label (whole numbers), values (array<int>), anchor (boolean). For each anchor and each of its first
    `positives` rows of the same label: the first `negatives` rows of other labels with least_percent * positive_score
    <= 100 * negative_score <= most_percent * positive_score. Scores are inner products; higher ones come first, ties by
    smaller vec_id. Exact.

    Rows with a null vec_id, label or values take no part; empty vectors score 0. A row isn't its own positive, nor are
    rows that share its vec_id; otherwise repeated rows count as often as they occur, and equal anchors once. A positive
    with a score below 0 has no window, one with 0 only scores of 0. An empty table gives no rows; other columns of rows
    aren't read."""
    taking = rows.select(*[F.col(c).cast("long").alias(c) for c in ("vec_id", "label")], "values", "anchor").filter("vec_id is not null and label is not null and values is not null")
    blocks = materialise(pack(taking), "negatives-blocks")
    asked = taking.filter("anchor").withColumn("_anchor", F.xxhash64("vec_id", "label", "values")).dropDuplicates(["vec_id", "_anchor"])
    anchors = materialise(asked.select("vec_id", "label", "values", "_anchor"), "negatives-anchors")
    near = _cells(blocks, anchors, _positives(positives), "vec_id long, _anchor long, positive_id long, positive_score long")
    near = _first(near, ["vec_id", "_anchor"], "positive_score", "positive_id", positives, "positive_rank")
    lists = near.groupBy("vec_id", "_anchor").agg(F.array_sort(F.collect_list(F.struct("positive_rank", "positive_id", "positive_score"))).alias("positives"))
    armed = materialise(anchors.join(lists, ["vec_id", "_anchor"]), "negatives-windows")
    found = _cells(blocks, armed, _negatives(negatives, least_percent, most_percent), "anchor_id long, _anchor long, positive_rank int, positive_id long, positive_score long, negative_id long, negative_score long")
    return _first(found, ["anchor_id", "_anchor", "positive_rank"], "negative_score", "negative_id", negatives, "rank").drop("_anchor")


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", label.alias("label"), whole_numbers("embedding").alias("values"), (F.col("vec_id") % 100 == 0).alias("anchor"))
    return hard_negatives(rows).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


OP12_SQL = """WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) AS k FROM s WHERE same) WHERE k <= 5
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM (
  SELECT p.anchor_id, positive_id, other_id AS negative_id, positive_score, score AS negative_score, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
) WHERE rank <= 10"""
