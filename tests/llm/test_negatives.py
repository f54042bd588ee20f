"""Hard negatives against all pairs."""

from __future__ import annotations

import math

import numpy as np
import pytest

from cairnbook.llm import negatives

SCHEMA = "vec_id long, label int, embedding array<float>"


def plain(rows):
    """All pairs in plain Python."""
    taking = []
    for vec_id, label, vector in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        taking.append((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in vector]))
    out, seen = [], set()
    for a, label, v in taking:
        if a % 100 or (a, label, tuple(v)) in seen:
            continue
        seen.add((a, label, tuple(v)))
        scored = sorted(((-sum(x * y for x, y in zip(v, w, strict=False)), b, other) for b, other, w in taking if b != a))
        for s, b, _ in [x for x in scored if x[2] == label][:5]:
            fit = [x for x in scored if x[2] != label and 30 * -s <= 100 * -x[0] <= 90 * -s]
            out += [(a, b, k, n, -s, -t) for k, (t, n, _) in enumerate(fit[:10], 1)]
    return sorted(out)


def query(spark, rows, tmp_path, parts=3):
    spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as values", "'x' as anchor", "2 as _anchor").repartition(parts).write.parquet(f"{tmp_path}/embeddings.parquet")
    return sorted(map(tuple, negatives.op12_hard_negatives(spark, str(tmp_path)).collect()))


@pytest.mark.parametrize("seed", range(4))
def test_random_rows(spark, tmp_path, seed, monkeypatch):
    monkeypatch.setattr(negatives, "GROUP", 2)
    rng = np.random.default_rng(seed)
    n, dims = 1500, [3, 8, 33, 64][seed]
    x = rng.normal(size=(n, dims)) * rng.uniform(0.1, 1, (n, 1))
    if seed == 1:
        x[: n // 3] = x[0]  # a third of the rows share a vector
    if seed == 2:
        x = np.abs(x) * (rng.random((n, dims)) < 0.2)
    labels = rng.integers(0, 10, n) if seed != 3 else np.where(rng.random(n) < 0.4, 3, 9)
    rows = [(int(i), int(c), v.tolist()) for i, (c, v) in enumerate(zip(labels, x.astype(np.float32), strict=True))]
    want = plain(rows)
    assert want and query(spark, rows, tmp_path) == want


def test_awkward_rows(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 0.5]), (0, 1, [1.0, 0.5]), (100, 1, [0.25]), (200, None, [1.0, 1.0]), (300, 2, None), (400, 2, [nan, 1.0]), (500, 2, [None, 1.0]), (None, 1, [1.0, 1.0]),
            (600, 2, [0.0, 0.0]), (700, 3, []), (1, 1, [0.9, 0.5]), (2, 1, [0.9, 0.5]), (3, 2, [0.5, 0.5]), (3, 2, [0.5, 0.5]), (4, 2, [0.5, 0.25]), (5, 3, [-1.0, -1.0]), (6, 2, [0.0, inf])]
    want = plain(rows)
    assert {r[0] for r in want} >= {0, 100}
    assert query(spark, rows, tmp_path) == want


def test_empty_table(spark, tmp_path):
    assert query(spark, [], tmp_path) == []


def test_huge_components_are_held(spark):
    got = spark.createDataFrame([([1e300, -1e300, 0.5],)], "v array<double>").select(negatives.whole_numbers("v")).first()[0]
    assert got == [1 << 20, -(1 << 20), 128]


def test_index_omits_what_bounds_cover_and_loses_nothing():
    rng = np.random.default_rng(5)
    x = np.floor(rng.normal(size=(500, 64)) * 40 * 0.9 ** np.arange(64)).astype(np.int64)
    a = x[:20]
    scores = a @ x.T
    least = np.partition(scores, -8, axis=1)[:, -8].astype(float)
    i, j, s = negatives.Index(x).search(a, least, np.full(20, np.inf))
    want = {(p, q, int(scores[p, q])) for p, q in zip(*np.nonzero(scores >= least[:, None]), strict=True)}
    assert {*zip(i.tolist(), j.tolist(), s.tolist(), strict=True)} == want
