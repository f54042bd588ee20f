"""Periodic runs of words: stretches that repeat their first `period` words at least four times.

Recursive frequency splitting: a run of power four or more holds each of its words at least four times. So a word that a
segment (at first a whole text) holds fewer times lies in no run, and splits the segment; the parts are split again by
their own counts until none changes. What survives is lag-scanned. The lags of a segment are taken in rising order; a run
of lag q covers three equal blocks between multiples of q, so the hashes of the n / q blocks tell whether the n words
need to be compared with those q later, and all lags of a segment cost n log n hash comparisons together.

Scale: one pass, no shuffle; all texts of a batch are split together, and state is bounded by a batch or by one text.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnbook.llm.shared import bounded, mix, pieces, text_or_empty

LEAST_WORDS, LEAST_POWER = 6, 4
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _edges(positions: np.ndarray, segments: np.ndarray) -> np.ndarray:
    """Where a new segment starts among kept positions: after a gap, or where the old segment changes."""
    new = np.ones(len(positions), bool)
    new[1:] = (np.diff(positions) != 1) | (np.diff(segments) != 0)
    return new


def surviving_segments(words: np.ndarray, owners: np.ndarray) -> list[tuple[int, int]]:
    """(first, end) of the segments that splitting leaves. words: ids; owners: a number that differs between texts."""
    positions, segments, size, done = np.arange(len(words)), owners, int(words.max(initial=0)) + 1, []
    while len(positions):
        _, at, counts = np.unique(segments * size + words[positions], return_inverse=True, return_counts=True)
        rare = counts[at] < LEAST_POWER
        split = np.zeros(int(segments.max()) + 1, bool)
        split[segments[rare]] = True
        stable = ~split[segments]
        first = np.flatnonzero(_edges(positions[stable], segments[stable]))
        ends = np.append(first[1:], stable.sum())[: len(first)]
        done += [(int(a), int(b) + 1) for a, b in zip(positions[stable][first], positions[stable][ends - 1], strict=True)]
        kept = ~stable & ~rare
        positions, segments = positions[kept], segments[kept]
        new = _edges(positions, segments)
        segments = np.cumsum(new) - 1
        long_enough = np.bincount(segments, minlength=1)[segments] >= LEAST_WORDS if len(segments) else np.zeros(0, bool)
        positions, segments = positions[long_enough], segments[long_enough]
    return sorted(x for x in done if x[1] - x[0] >= LEAST_WORDS)


def _blocks_repeat(sums: np.ndarray, powers: np.ndarray, lag: int, known: dict[int, np.ndarray]) -> bool:
    """Whether three neighbouring blocks of `lag` words have one hash where no known run, of a period that divides the
    lag, says so already: inside such a run the stretch of this lag is that run."""
    at = np.arange(0, len(sums), lag)
    blocks = (sums[at[1:]] - sums[at[:-1]]) * powers[at[:-1]]
    same = blocks[1:] == blocks[:-1]
    hits = np.flatnonzero(same[1:] & same[:-1])
    if len(hits):
        starts = hits * lag
        open_ = np.ones(len(hits), bool)
        for period, runs in known.items():
            if lag % period == 0:
                before = np.searchsorted(runs[:, 0], starts, side="right") - 1
                open_ &= (before < 0) | (runs[before, 1] < starts + 3 * lag)
        return bool(open_.any())
    return False


def lag_scan(words: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a segment: maximal stretches with smallest period q and a length of at
    least max(6, 4 q)."""
    n = len(words)
    powers = np.full(n + 1, _BASE, np.uint64)
    powers[0] = 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(words.astype(np.uint64) + np.uint64(0x51ED27)) * np.multiply.accumulate(powers)[:n], out=sums[1:])
    powers[1:] = _INVERSE
    powers = np.multiply.accumulate(powers)
    known: dict[int, np.ndarray] = {}
    seen, found = set(), []
    for lag in range(1, n // LEAST_POWER + 1):
        if not _blocks_repeat(sums, powers, lag, known):
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[False], words[:-lag] == words[lag:], [False]]).astype(np.int8)))
        starts, ends = edges[::2], edges[1::2] + lag
        fit = ends - starts >= max(LEAST_WORDS, LEAST_POWER * lag)
        new = [(a, b) for a, b in zip(starts[fit].tolist(), ends[fit].tolist(), strict=True) if (a, b) not in seen]
        if new:
            seen.update(new)
            known[lag] = np.array(new)
            found += [(a, b - a, lag) for a, b in new]
    return found


def runs_of_texts(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each text, given as words, by start, then period."""
    sizes = np.array([len(t) for t in texts], np.int64)
    flat = pa.array([w for t in texts for w in t], pa.large_binary()).dictionary_encode()
    ids = flat.indices.to_numpy().astype(np.int64)
    firsts = np.concatenate([[0], np.cumsum(sizes)])
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for a, b in surviving_segments(ids, np.repeat(np.arange(len(texts)), sizes)):
        text = int(np.searchsorted(firsts, a, side="right")) - 1
        found[text] += [(start + a - int(firsts[text]), length, period) for start, length, period in lag_scan(np.unique(ids[a:b], return_inverse=True)[1])]
    return [sorted(f, key=lambda r: (r[0], r[2])) for f in found]


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: those that no run holds after its first period."""
    depth = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return np.cumsum(depth)[:n] == 0


_RUN = T.StructType().add("start", "long").add("length", "long").add("period", "long")
_ADDED = [T.StructField("runs", T.ArrayType(_RUN)), T.StructField("best", _RUN), T.StructField("collapsed", T.StringType())]


def periodic_runs(docs: DataFrame) -> DataFrame:
    """docs with `text` replaced by `runs` (start, length and period in words, by start, then period), `best` (the run of
    the greatest length / period, ties by smallest start, then period; null without runs) and `collapsed` (the words that
    no run holds after its first period, joined by one space).

    Null, empty or blank text: no runs, empty collapsed text. Repeated rows are treated alike; an empty table gives no
    rows; columns of docs named runs, best or collapsed are replaced, others pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 1 << 20):
            texts = [t.encode().split() for t in batch.column("text").to_pylist()]
            found = runs_of_texts(texts)
            collapsed = [b" ".join(t if not r else [t[i] for i in np.flatnonzero(kept_words(len(t), r))]) for t, r in zip(texts, found, strict=True)]
            best = [max(r, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=None) for r in found]
            named = lambda x: x and dict(zip(_RUN.names, x, strict=True))
            kind = pa.struct([(f, pa.int64()) for f in _RUN.names])
            arrays = [pa.array([[*map(named, r)] for r in found], pa.list_(kind)), pa.array([named(b) for b in best], kind), pa.array(collapsed, pa.binary()).cast(pa.string())]
            rest = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *arrays], names=[*rest, *(f.name for f in _ADDED)])

    source = bounded(docs.drop(*(f.name for f in _ADDED))).withColumn("text", text_or_empty())
    return source.mapInArrow(run, T.StructType([*(f for f in source.schema.fields if f.name != "text"), *_ADDED]))


def planted(docs: DataFrame) -> DataFrame:
    """docs whose texts, for a tenth of the doc_ids by their CRC-32, go on periodically from a word on. Null doc_id: as it
    is."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def repeated(w: Column) -> Column:
        n = F.size(w)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        return F.transform(F.sequence(F.lit(0).cast("long"), (n - 1).cast("long")), lambda i: F.get(w, F.when(i >= a, a + F.pmod(i - a, p)).otherwise(i).cast("int")))

    # lists of one bind the words to a name, so they are split once
    text = F.element_at(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, F.array_join(repeated(w), " "))), 1)
    return docs.withColumn("text", F.when(F.pmod(h, F.lit(10)) == 0, text).otherwise(F.col("text")))


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    found = periodic_runs(planted(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[f].cast("string") for f in _RUN.names]), F.lit("\n"))), "")
    best = lambda f: F.col(f"best.{f}").alias(f)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *map(best, _RUN.names),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
