"""Quality rules against a plain count, mixing against its contract."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnbook.llm import mixing, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    inside = {i + k for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for k in range(8)}
    return (len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside))


@pytest.mark.parametrize("table", ["docs", "awkward"])
def test_base_figures(request, table):
    rows = request.getfixturevalue(table)
    texts = {r["doc_id"]: r["text"] for r in rows.collect()}
    got = quality.quality_rules(rows).collect()
    assert len(got) == rows.count()
    for r in got:
        want = base(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        failed = want[0] < 20 or 100 * want[4] > 30 * want[0]
        assert r["base_failed"] is failed and not (failed and r["kept"])


def test_outliers_go_and_clean_texts_stay(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = quality.quality_rules(d)
    again = quality.quality_rules(d.repartition(7))
    assert sorted(map(tuple, out.select("doc_id", "kept").collect())) == sorted(map(tuple, again.select("doc_id", "kept").collect()))
    met = out.join(labels, "doc_id").filter("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("kept")).collect()
    kept = {r["quality"]: r["kept"] for r in met}
    assert kept[1] > 0.99 and kept[0] < 0.2


def test_concentration_finds_the_core(spark):
    rng = np.random.default_rng(1)
    good = rng.normal(0, 1, (900, len(quality.VECTOR)))
    bad = rng.normal(8, 0.3, (100, len(quality.VECTOR)))
    rows = [("en", "s", k, *(int(v * quality.UNIT) for v in x)) for k, x in enumerate(np.vstack([good, bad]))]
    fit = quality.fit_mcd(spark.createDataFrame(rows, FIXED)).collect()
    assert len(fit) == 1 and np.abs(np.array(fit[0]["centre"])).max() < 0.3


FIXED = "lang string, source string, u long, " + ", ".join(f"v{i} long" for i in range(len(quality.VECTOR)))


def fixed(vectors, source="s"):
    return [("en", source, k, *(round(v * quality.UNIT) for v in x)) for k, x in enumerate(vectors)]


def test_a_group_of_sixty_rows_is_judged_by_its_own_estimate(spark):
    rng = np.random.default_rng(2)
    p = len(quality.VECTOR)
    large, small = rng.normal(0, 0.2, (600, p)), rng.normal(3, 0.2, (60, p))
    fit = {r["source"]: r for r in quality.fit_mcd(spark.createDataFrame(fixed(large) + fixed(small, "t"), FIXED)).collect()}
    distance = lambda r, x: (x - np.array(r["centre"])) @ np.array(r["inverse"]).reshape(p, p) @ (x - np.array(r["centre"])) / r["factor"]
    centre = np.array(fit["t"]["centre"])
    assert (centre > 1).all() and np.abs(np.array(fit["s"]["centre"])).max() < 0.4
    # few rows say less: their own centre weighs 60 of 110
    assert np.allclose(centre, (60 * small.mean(0) + 50 * np.array(fit["s"]["centre"])) / 110, atol=0.35)
    assert distance(fit["s"], np.full(p, 3.0)) > 5 * distance(fit["t"], np.full(p, 3.0))


def test_concentration_reaches_the_least_determinant(spark):
    """All subsets of a tiny table are tried: none has a smaller determinant than the core that was found."""
    from itertools import combinations

    rng = np.random.default_rng(3)
    p = len(quality.VECTOR)
    x = np.round(np.vstack([rng.normal(0, 0.4, (9, p)), rng.normal(6, 0.4, (3, p))]) * quality.UNIT) / quality.UNIT
    best = min(combinations(range(12), 9), key=lambda c: np.log(quality._floored(np.cov(x[list(c)].T, bias=True))[1]).sum())
    assert best == tuple(range(9))
    fit = quality.fit_mcd(spark.createDataFrame(fixed(x), FIXED)).collect()[0]
    # one group: all levels agree, so the prior changes nothing
    assert np.allclose(fit["centre"], x[:9].mean(0), atol=1e-9)
    assert np.allclose(np.array(fit["inverse"]).reshape(p, p), quality._floored(np.cov(x[:9].T, bias=True))[0], rtol=1e-6)


@pytest.mark.parametrize("n", [1, 3])
def test_few_rows_are_kept(spark, n):
    text = "Every morning the baker opens a small shop near the old bridge and sells warm bread to people who walk by on their way"
    rows = spark.createDataFrame([(k, text + " again" * k, "en", "s") for k in range(n)], "doc_id long, text string, lang string, source string")
    assert [r["kept"] for r in quality.quality_rules(rows).collect()] == [True] * n


def test_empty(empty):
    assert quality.quality_rules(empty).count() == 0 and mixing.mix_sources(empty).count() == 0


@pytest.mark.parametrize("table", ["docs", "awkward"])
def test_mixing(request, table):
    rows = request.getfixturevalue(table)
    texts = {r["doc_id"]: r for r in rows.collect()}
    got = mixing.mix_sources(rows).collect()
    assert len(got) == rows.count()
    sizes, taken, targets = Counter(), Counter(), {}
    for r in got:
        assert r["size"] == len(WORD.findall(texts[r["doc_id"]]["text"] or "")) and 0 <= r["repeats"] <= 2
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["size"] * r["repeats"]
        targets[r["source"]] = r["target"]
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    done: set = set()
    while True:
        left = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in done)
        share = {s: left * weight[s] / sum(weight[x] for x in order if x not in done) for s in order if s not in done}
        over = {s for s, t in share.items() if t > 2 * sizes[s]}
        if not over:
            break
        done |= over
    for s in order:
        assert targets[s] == pytest.approx(2 * sizes[s] if s in done else share[s])
    for s in order:
        passes = min(int(targets[s] // sizes[s]), 2) if sizes[s] else 0
        sums = {0}
        for r in got:
            if r["source"] == s:
                sums |= {x + r["size"] for x in sums}
        rest = targets[s] - passes * sizes[s]
        assert passes == 2 or abs(taken[s] - targets[s]) <= min(abs(x - rest) for x in sums) + 1e-6
    again = mixing.mix_sources(rows.repartition(5)).collect()
    key = lambda r: (r["doc_id"], r["repeats"])
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_knapsack_is_as_near_as_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(60):
        lengths = np.unique(rng.integers(1, 30, 4))
        counts = rng.integers(1, 4, len(lengths))
        budget = float(rng.uniform(0, (lengths * counts).sum()))
        sums = {0}
        for x, n in zip(lengths.tolist(), counts.tolist(), strict=True):
            sums = {s + k * x for s in sums for k in range(n + 1)}
        took = mixing.fit_counts(lengths, counts, budget)
        assert (took <= counts).all() and (took >= 0).all()
        assert abs((took * lengths).sum() - budget) <= min(abs(s - budget) for s in sums) + 1e-9


def test_every_length_gives_its_share():
    took = mixing.fit_counts(np.array([10, 20, 30, 40]), np.array([10, 10, 10, 10]), 300.0)
    assert took.tolist() == [3, 3, 3, 3]
    # one very long text doesn't leave the choice of all others to the repair
    lengths, counts = np.array([*range(1, 51), 100_000]), np.array([1000] * 50 + [1])
    budget = 400_000.0
    took = mixing.fit_counts(lengths, counts, budget)
    assert (took * lengths).sum() == budget
    assert np.abs(took - counts * budget / (lengths * counts).sum())[:50].max() <= 150 and (took[:50] > 0).all()
    lengths, counts = np.arange(1, 2001), np.full(2000, 3)
    took = mixing.fit_counts(lengths, counts, 1_500_000.0)
    assert (took * lengths).sum() == 1_500_000 and abs((took * lengths)[1500:].sum() / (lengths * counts)[1500:].sum() - 0.25) < 0.02


@pytest.mark.parametrize("freedom", [2.5, 4.0, 12.0])
def test_the_cut_is_fitted_to_the_tail_and_ignores_outliers(freedom):
    """Distances drawn from F(7, f), a tenth of them replaced by outliers: the cut is near that of the true freedom."""
    rng = np.random.default_rng(2)
    d = rng.chisquare(7, 200_000) / 7 / (rng.chisquare(freedom, 200_000) / freedom)
    d *= quality.CHI2_MEDIAN / quality.f_quantile(0.5, freedom)
    d[:20_000] = rng.uniform(5e4, 9e4, 20_000)
    buckets = Counter(np.floor(np.log(d) * quality.BUCKETS).astype(int).tolist())
    cut = quality.fitted_cut(sorted(buckets.items()))
    true = quality.CHI2_MEDIAN * quality.f_quantile(0.999, freedom) / quality.f_quantile(0.5, freedom)
    assert 0.5 < cut / true < 2.5 and cut < 4e4
    assert abs(np.mean(d[20_000:] <= quality.CHI2_MEDIAN) - 0.5) < 0.01


def test_the_cut_of_no_rows_is_that_of_the_prior():
    prior = quality.CHI2_MEDIAN * quality.f_quantile(0.999, quality.PRIOR_FREEDOM) / quality.f_quantile(0.5, quality.PRIOR_FREEDOM)
    assert 0.5 < quality.fitted_cut([]) / prior < 2
