"""Periodic runs against a plain scan of all lags."""

from __future__ import annotations

import random
import re
from fractions import Fraction
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnbook.llm import periodic

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(w):
    found, ids = {}, np.unique(w, return_inverse=True)[1] if w else np.zeros(0, int)
    for q in range(1, len(w) // 4 + 1):
        differ = np.concatenate([[-1], np.flatnonzero(ids[:-q] != ids[q:]), [len(w) - q]])
        gaps = np.diff(differ) - 1 + q
        for k in np.flatnonzero(gaps >= max(6, 4 * q)):
            found.setdefault((int(differ[k]) + 1, int(gaps[k])), q)
    return sorted(((a, n, q) for (a, n), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    w = WORD.findall(text or "")
    n = len(w)
    if doc_id is not None and n:
        h = crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    kept = [x for i, x in enumerate(w) if not any(s + q <= i < s + m for s, m, q in runs)]
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
    sha = lambda s: sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *best, best[0] if best[0] is None else best[1] * 1000 // best[2], sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(kept)))


def rows_of(found):
    return sorted(map(tuple, found.collect()), key=str)


def query_on(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    return periodic.op13_periodic_runs(spark, str(tmp_path))


def test_whole_table_against_plain_scan(spark, docs, small):
    want = sorted((plain_row(r["doc_id"], r["text"]) for r in docs.collect()), key=str)
    assert rows_of(periodic.op13_periodic_runs(spark, small)) == want
    assert sum(r[1] > 0 for r in want) > 5


def test_awkward_rows(spark, awkward, tmp_path):
    extra = spark.createDataFrame([(None, "a " * 9), (None, None), (70, "x y " * 5 + "z"), (71, "           ")], "doc_id long, text string")
    docs = awkward.select("doc_id", "text", *[F.lit("x").alias(c) for c in ("runs", "best", "collapsed")]).unionByName(extra, allowMissingColumns=True)
    want = sorted((plain_row(r["doc_id"], r["text"]) for r in docs.collect()), key=str)
    assert rows_of(query_on(spark, docs, tmp_path)) == want


def test_empty_table(spark, empty, tmp_path):
    assert query_on(spark, empty, tmp_path).collect() == []


@pytest.mark.parametrize("seed", range(40))
def test_random_words(seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(30):
        n, k = rng.randint(0, 90), rng.randint(1, 4)
        w = [b"%d" % rng.randrange(k) for _ in range(n)]
        if n > 4 and rng.random() < 0.7:
            p, a = rng.randint(1, 9), rng.randrange(n)
            w = [w[i if i < a else a + (i - a) % p] for i in range(n)]
        texts.append(w)
    assert periodic.runs_of_texts(texts) == [plain_runs(w) for w in texts]


def test_splitting_keeps_texts_apart_and_recurses():
    w = [b"a"] * 3
    assert periodic.runs_of_texts([w, w, w]) == [[], [], []]
    ids = np.array([0, 1] * 4 + [2] + [3] * 5 + [0, 1])  # 2 is rare; then 3 stands alone, too short; 0 and 1 stay
    assert periodic.surviving_segments(ids, np.zeros(len(ids), np.int64)) == [(0, 8)]


def test_long_texts_take_time_in_proportion():
    import time

    began = time.time()
    one, mixed = [b"a"] * 200_000, [b"a", b"b", b"a", b"c"] * 50_000
    assert periodic.runs_of_texts([one, mixed]) == [[(0, 200_000, 1)], [(0, 200_000, 4)]]
    assert time.time() - began < 30
