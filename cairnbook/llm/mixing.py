"""Mixing sources to target weights by subset-sum budget fitting.

Each source has a budget of words. Documents are counted by their exact length; whole passes over a source are taken
first, then a proportional share of every length, rounded up or down, and a bounded-knapsack dynamic programme over
(length, count) pairs adds and removes a few documents, so that the sum comes as near the budget as the lengths allow.
Seeded hashes decide which documents of a length are taken.

Scale: per source only the table of distinct lengths goes to one task (bounded by the longest text, not by the number
of rows). Documents of one length are ranked inside hash cells of about CELL rows, never as one group.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnbook.llm.shared import WORD, materialise, mix, salted_left_join

WEIGHTS = (5, 2, 1)
BUDGET_PERCENT = 150
#: No source gives more than this many times its size, and no document is taken more often.
MOST_PASSES = 2
SEED = 20240229
#: Rows of one source and length that share a hash cell, about.
CELL = 512
#: Words to either side of the proportional share that the last repair covers; a longer text widens it.
WIDTH = 1 << 21



def text_size() -> Column:
    """Words of the whole text; 0 for null."""
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = BUDGET_PERCENT) -> DataFrame:
    """sizes: source, source_size. Adds target: sources by code point (null last) weigh `weights` in turn and share
    percent of all sizes; a source stops at MOST_PASSES times its size and the others share its excess by weight.

    A source stops early if its cap per unit of weight is low, so the stopped ones are the first in that order: the
    level of the rest is what remains by the weight that remains, where no later source is above its cap."""
    everything = Window.partitionBy(F.lit(0))
    ranked = sizes.withColumn("_rank", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("_weight", weight.cast("long")).withColumn("_cap", F.col("source_size") * MOST_PASSES)
    order = everything.orderBy(F.col("_cap") / F.col("_weight"), "_rank")
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) * percent / 100 - F.coalesce(F.sum("_cap").over(upto), F.lit(0))
    heavy = F.sum("_weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    ranked = ranked.withColumn("_level", left / heavy)
    open_ = F.col("_level") * F.col("_weight") <= F.col("_cap")
    level = F.min_by(F.when(open_, F.col("_level")), F.when(open_, F.struct(F.col("_cap") / F.col("_weight"), "_rank"))).over(everything)
    target = F.least(F.coalesce(F.col("_weight") * level, F.col("_cap").cast("double")), F.col("_cap").cast("double"))
    return ranked.select("source", "source_size", target.cast("double").alias("target"))


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: float) -> np.ndarray:
    """How many documents of each length to take (at most counts) for a sum as near the budget as can be reached.

    Every length gives its proportional share, rounded up or down so that the words owed stay under half a text. What
    is owed at the end is repaired by few documents of each length, by more only if few don't reach the nearest sum."""
    take = np.zeros(len(lengths), np.int64)
    have = int((lengths * counts).sum())
    if not have or budget <= 0:
        return take
    if budget >= have:
        return counts.copy()
    share = counts * (budget / have)
    take, owed = np.minimum(counts, np.floor(share).astype(np.int64)), 0.0
    for i in np.argsort(lengths, kind="stable"):
        owed += float(share[i] - take[i]) * int(lengths[i])
        if take[i] < counts[i] and 2 * owed >= lengths[i]:
            take[i] += 1
            owed -= int(lengths[i])
    rest, step, most = budget - int((take * lengths).sum()), 1, int(counts.max())
    while True:
        change, exact = _repair(lengths, counts, take, rest, step, step >= most)
        if exact or step >= most:
            return take + change
        step = min(2 * step, most)


def _repair(lengths: np.ndarray, counts: np.ndarray, take: np.ndarray, rest: float, step: int, last: bool) -> tuple[np.ndarray, bool]:
    """Documents to add or remove (at most `step` of each length) for a sum near rest, and whether none is nearer.

    Reachable sums are bits of one integer; each length, in seeded order, is offered in powers of two both ways, and
    the first item to reach a sum is kept for the way back."""
    longest, unit = int(lengths.max()), int(np.gcd.reduce(lengths))
    add, remove = np.minimum(counts - take, step), np.minimum(take, step)
    width = max(int(math.ceil(abs(rest))) + longest, WIDTH if last else min(step * longest, WIDTH))
    down, up = min(int((remove * lengths).sum()), width), min(int((add * lengths).sum()), width)
    nearest = down + round(rest / unit) * unit
    size = down + up + 1
    items, reach, mask = [], 1 << down, (1 << size) - 1
    found = np.full(size, -1, np.int32)

    def offered():
        for i in np.argsort(mix(lengths.astype(np.uint64) + np.uint64(SEED)), kind="stable").tolist():
            for sign, n in ((-1, int(remove[i])), (1, int(add[i]))):
                n, k = min(n, size // int(lengths[i])), 1
                while n > 0:
                    yield i, sign * min(k, n)
                    n, k = n - k, 2 * k

    exact = nearest == down
    for i, k in () if exact else offered():
        by = k * int(lengths[i])
        new = ((reach << by) & mask if by > 0 else reach >> -by) & ~reach
        if new:
            bits = np.unpackbits(np.frombuffer(new.to_bytes(size // 8 + 1, "little"), np.uint8), bitorder="little")
            found[np.flatnonzero(bits[:size])] = len(items)
            reach |= new
        items.append((i, k))
        exact = 0 <= nearest < size and bool(found[nearest] >= 0)
        if exact:
            break
    sums = np.union1d(np.flatnonzero(found >= 0), [down])
    at = int(sums[np.argmin(np.abs(sums - down - rest))])
    change = np.zeros(len(lengths), np.int64)
    while at != down:
        i, k = items[found[at]]
        change[i] += k
        at -= k * int(lengths[i])
    return change, exact


def _fit(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("size", kind="stable")
    lengths, counts = frame["size"].to_numpy(np.int64), frame["n"].to_numpy(np.int64)
    target, have = float(frame["target"].iloc[0]), int((lengths * counts).sum())
    passes = min(int(target // have), MOST_PASSES) if have else 0
    extra = fit_counts(lengths, counts, target - passes * have) if passes < MOST_PASSES else np.zeros(len(lengths), np.int64)
    return pd.DataFrame({"source": frame["source"], "size": lengths, "n": counts, "passes": passes, "extra": extra})


def mix_sources(docs: DataFrame, key: str = "doc_id", weights: tuple[int, ...] = WEIGHTS, percent: int = BUDGET_PERCENT, seed: int = SEED) -> DataFrame:
    """docs: key, source, text. Returns key, source, size, source_size, target, repeats (times the mix takes the
    document, 0 to MOST_PASSES) per row.

    Null source: a source of its own, ranked last. Null or empty text: size 0, never taken. Ties of the seeded hash go
    by the text's hash; rows equal in key and text are interchangeable. Null key: hashed like a value. Empty table: no
    rows. Further columns of docs are ignored."""
    rows = docs.select(F.col(key).alias("doc_id"), "source", text_size().alias("size"), F.xxhash64("text").alias("_t"))
    rows = materialise(rows.withColumn("_u", F.xxhash64(F.lit(seed), "doc_id")), "mix-sizes")
    lengths = materialise(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-lengths")
    targets = materialise(source_targets(lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, percent), "mix-targets")
    offered = lengths.filter("size > 0").join(targets.select(F.col("source").alias("_s"), "target"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    plan = materialise(offered.groupBy("source").applyInPandas(_fit, "source string, size long, n long, passes long, extra long"), "mix-plan")
    # cells: the top bits of the seeded hash, as many as make about CELL rows
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / CELL))).cast("int")
    planned = plan.select("source", "size", "passes", "extra", F.when(F.col("extra").between(1, F.col("n") - 1), bits).alias("_bits"))
    rows = salted_left_join(rows, planned, ["source", "size"])
    rows = rows.withColumn("_cell", F.expr("shiftrightunsigned(_u, 63 - _bits) & (shiftleft(1L, _bits) - 1)"))
    partial = rows.filter(F.col("_bits").isNotNull()).groupBy("source", "size", "_cell").agg(F.count("*").alias("_c"), F.first("extra").alias("_e"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy("source", "size").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edges = partial.withColumn("_b", before).filter((F.col("_b") < F.col("_e")) & (F.col("_e") <= F.col("_b") + F.col("_c")))
    edges = edges.select("source", "size", F.col("_cell").alias("_edge"), (F.col("_e") - F.col("_b")).alias("_need"))
    rows = salted_left_join(rows, edges, ["source", "size"])
    inside = F.row_number().over(Window.partitionBy("source", "size", "_edge").orderBy("_u", "doc_id", "_t"))
    on_edge = F.col("_cell") == F.col("_edge")
    sure = rows.filter(~F.coalesce(on_edge, F.lit(False)))
    sure = sure.withColumn("_x", F.when(F.col("_edge").isNotNull(), (F.col("_cell") < F.col("_edge")).cast("int")).otherwise((F.col("extra") > 0).cast("int")))
    edge = rows.filter(on_edge).withColumn("_x", (inside <= F.col("_need")).cast("int"))
    repeats = F.coalesce(F.col("passes") + F.col("_x"), F.lit(0)).cast("int")
    taken = sure.unionByName(edge).select("doc_id", "source", "size", repeats.alias("repeats"), "_t")
    out = salted_left_join(taken, targets, ["source"])
    return out.select(F.col("doc_id").alias(key), "source", "size", "source_size", "target", "repeats", F.col("_t").alias("text_hash"))


def op2_mix_sources(spark, sf_dir: str) -> DataFrame:
    mixed = mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).cast("long").alias("taken"))
