"""Quality rules: robust multivariate outliers by minimum-covariance-determinant estimates.

Base figures of each text (words, repeated lines, repeated 8-word windows, symbols, ...) are transformed into a
vector; per language and source a minimum-covariance-determinant (MCD) estimate of its centre and scatter is found by
concentration steps that cover all rows, and texts with a large Mahalanobis distance are rejected. A group of n rows
counts n, the estimate of its language PRIOR_ROWS (and that of all rows the same for the language's), so every group is
judged by its own estimate as far as it has rows for one, and no size switches the rule.

Scale: texts are read once and become rows of a few numbers. A concentration step is one join with the parameters
(one row per group) and one partially aggregated sum; groups of any size are never brought together. Vectors are
fixed-point, so sums are exact and reruns agree whatever the partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnbook.llm.shared import bounded, materialise, pieces, salted_left_join, word_hashes

WINDOW_WORDS = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Fixed-point unit of the transformed statistics.
UNIT = 512
#: Distances fall into buckets of 1/BUCKETS of a natural logarithm.
BUCKETS = 64
#: Share of a group's rows whose covariance determinant is minimised.
CORE_SHARE = 0.75
#: The transformed statistics.
VECTOR = ["length", "word_size", "symbols", "marks", "capitals", "dup_lines", "repeats"]
#: Least standard deviation along any axis of a scatter: many statistics are constant in the core of a group, and
#: differences of this size are no evidence.
LEAST_SD = 0.05
#: Rows for which the estimate of the wider group counts.
PRIOR_ROWS = 50
#: Chi-square median for seven degrees of freedom; distances are scaled so that a group's median is this.
CHI2_MEDIAN = 6.346
#: Statistics of texts have heavy tails, so distances are held against a multivariate t distribution instead of a normal
#: one: squared distances over seven are then F(7, f). The degrees of freedom f are fitted to each run's own distances,
#: to which PRIOR_ROWS of the prior f are added; the cut is this quantile.
PRIOR_FREEDOM, CUT_SHARE = 3.0, 0.999
#: The fit compares these quantiles of what the cut keeps: first without, then up to the tail.
CORE_QUANTILES, TAIL_QUANTILES = (0.5, 0.75), (0.5, 0.9)
#: Concentration of a group ends when its log determinant falls by less than this (one row that changes sides moves it
#: by more only in tiny groups). Every further step costs a fall of that size, and determinants have a floor.
LEAST_FALL = 0.05

_SYMBOLS = b"#*$%&|<>"
_PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_CAPITALS = bytes(range(65, 91))
_ODD = np.array([(0x9E3779B97F4A7C15 * (2 * i + 1) + 2 * i) | 1 for i in range(WINDOW_WORDS)], dtype=object)
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_marks", "n_capitals", "n_lines"]


def _repeat_words(hashes: np.ndarray) -> int:
    """Words inside windows of WINDOW_WORDS words that occur at least twice."""
    n = len(hashes) - WINDOW_WORDS + 1
    if n < 2:
        return 0
    windows = np.zeros(n, np.uint64)
    for i, odd in enumerate(_ODD):
        windows += hashes[i:i + n] * np.uint64(int(odd) & 0xFFFFFFFFFFFFFFFF)
    ordered = np.sort(windows)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    marked = np.flatnonzero(np.isin(windows, twice))
    edges = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edges, marked, 1)
    np.add.at(edges, marked + WINDOW_WORDS, -1)
    return int(np.count_nonzero(np.cumsum(edges)))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        texts = batch.column("text")
        hashes, ends = word_hashes(texts)
        out = {name: np.zeros(batch.num_rows, np.int64) for name in STATS}
        for i, text in enumerate(texts):
            n = int(ends[i + 1] - ends[i])
            if not n:
                continue
            text = text.as_py()
            raw = text.encode()
            lines = [x for x in raw.split(b"\n") if x.strip()]
            out["n_words"][i] = n
            out["word_chars"][i] = len(text) - sum(map(text.count, " \t\n\v\f\r"))
            out["n_symbols"][i] = sum(raw.count(c) for c in _SYMBOLS)
            out["n_dup_lines"][i] = len(lines) - len(set(lines))
            out["n_lines"][i] = len(lines)
            out["n_repeat_words"][i] = _repeat_words(hashes[ends[i]:ends[i + 1]])
            out["n_marks"][i] = len(raw) - len(raw.translate(None, _PUNCTUATION))
            out["n_capitals"][i] = len(raw) - len(raw.translate(None, _CAPITALS))
        kept = [batch.column(c) for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*kept, *(pa.array(out[s]) for s in STATS)], names=[c for c in batch.schema.names if c != "text"] + STATS)


def text_statistics(docs: DataFrame, keys: list[str]) -> DataFrame:
    """keys and the base figures of each text: whole texts, one row per input row. A null or empty text has zeros."""
    source = bounded(docs.select(*keys, "text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.drop("text").schema.fields)
    return source.mapInArrow(_measure, f"{fields}, " + ", ".join(f"{s} long" for s in STATS))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _vector() -> dict[str, Column]:
    """Transformed statistics in fixed point."""
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    real = {
        "length": F.log(words),
        "word_size": F.log(chars / words),
        "symbols": F.log1p(20 * F.col("n_symbols") / words),
        "marks": F.log1p(F.col("n_marks") / words),
        "capitals": F.sqrt(F.col("n_capitals") / chars),
        "dup_lines": F.log1p(20 * F.col("n_dup_lines") / words),
        "repeats": F.sqrt(F.col("n_repeat_words") / words),
    }
    return {f"v{i}": F.round(real[name] * UNIT).cast("long") for i, name in enumerate(VECTOR)}


_P = len(VECTOR)
_PAIRS = [(i, j) for i in range(_P) for j in range(i, _P)]
_SUMS = [f"s{i}" for i in range(_P)] + [f"s{i}_{j}" for i, j in _PAIRS]


def _moments() -> list[Column]:
    """Exact sums of fixed-point values and products. A value is under 2 ** 14, so its squares fit into a long for
    3 * 10 ** 10 rows of one distance bucket; beyond that Spark raises an error."""
    return [F.count("*").alias("n"), *(F.sum(f"v{i}").alias(f"s{i}") for i in range(_P)), *(F.sum(F.col(f"v{i}") * F.col(f"v{j}")).alias(f"s{i}_{j}") for i, j in _PAIRS)]


def _floored(scatter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(inverse, eigenvalues) of a scatter, no axis of which varies by less than LEAST_SD."""
    values, axes = np.linalg.eigh((scatter + scatter.T) / 2)
    values = np.maximum(values, LEAST_SD**2)
    return axes @ np.diag(1 / values) @ axes.T, values


def _estimates(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Centre, scatter, its inverse and log determinant from sums; one row per group and start."""
    for frame in frames:
        rows = []
        for r in frame.to_dict("records"):
            n = max(float(r["n"]), 1.0)
            centre = np.array([float(r[f"s{i}"]) for i in range(_P)]) / n / UNIT
            scatter = np.zeros((_P, _P))
            for i, j in _PAIRS:
                scatter[i, j] = scatter[j, i] = float(r[f"s{i}_{j}"]) / n / UNIT**2 - centre[i] * centre[j]
            inverse, values = _floored(scatter)
            rows.append((r["grp"], r["start"], centre.tolist(), scatter.ravel().tolist(), inverse.ravel().tolist(), float(np.log(values).sum())))
        yield pd.DataFrame(rows, columns=["grp", "start", "centre", "scatter", "inverse", "log_det"])


def _inverted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        frame["inverse"] = [_floored(np.array(x).reshape(_P, _P))[0].ravel().tolist() for x in frame["scatter"]]
        yield frame


_ESTIMATES = "grp string, start int, centre array<double>, scatter array<double>, inverse array<double>, log_det double"


def _distance() -> Column:
    """Squared Mahalanobis distance, inside generated code."""
    off = [(F.col(f"v{i}") / UNIT - F.col("centre")[i]) for i in range(_P)]
    total = F.lit(0.0)
    for i, j in _PAIRS:
        total = total + off[i] * off[j] * F.col("inverse")[i * _P + j] * (1 if i == j else 2)
    return F.greatest(total, F.lit(0.0))


def _group_name(level: int) -> Column:
    """A group's key: 0 all rows, 1 the language, 2 the language and source. Nulls are a value of their own."""
    parts = [F.lit(level).alias("level"), F.col("lang"), F.col("source")][: level + 1]
    return F.to_json(F.struct(*parts))


def fit_mcd(rows: DataFrame) -> DataFrame:
    """One row per language and source: centre, inverse scatter and the consistency factor.

    rows: lang, source and the fixed-point vector. Starts: the rows around the coordinate-wise medians, and a seeded
    tenth of the rows; each goes through concentration steps until no determinant falls, and the smaller one wins."""
    levels = F.explode(F.array(*[F.named_struct(F.lit("level"), F.lit(k), F.lit("grp"), _group_name(k), F.lit("wider"), _group_name(max(k - 1, 0))) for k in range(3)]))
    vectors = [f"v{i}" for i in range(_P)]
    long = rows.select(levels.alias("g"), "lang", "source", "u", *vectors).select("g.*", "lang", "source", "u", *vectors)
    quartiles = [F.percentile(v, F.array(*map(F.lit, (0.25, 0.5, 0.75)))).alias(f"q{i}") for i, v in enumerate(vectors)]
    first = [F.first(c).alias(c) for c in ("lang", "source")]
    sizes = materialise(long.groupBy("level", "grp", "wider").agg(F.count("*").alias("total"), *first, *quartiles), "mcd-groups")
    spread = [1 / F.pow(F.greatest((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / (1.349 * UNIT), F.lit(LEAST_SD)), F.lit(2)) for i in range(_P)]
    diagonal = F.array(*[spread[i] if i == j else F.lit(0.0) for i in range(_P) for j in range(_P)])
    middle = F.array(*[F.col(f"q{i}")[1] / UNIT for i in range(_P)])
    around = sizes.select("grp", F.lit(0).alias("start"), middle.alias("centre"), F.array().cast("array<double>").alias("scatter"), diagonal.alias("inverse"), F.lit(1e6).alias("log_det"))
    seeded = long.filter(F.col("u") % 10 == 0).groupBy("grp").agg(*_moments()).withColumn("start", F.lit(1))
    # a start isn't a core yet: whatever its determinant, the first step is taken
    params = materialise(around.unionByName(seeded.mapInPandas(_estimates, _ESTIMATES).withColumn("log_det", F.lit(1e6))), "mcd-start")
    ended, moving = params.limit(0), params
    while True:
        step = _concentrate(long, sizes, moving).mapInPandas(_estimates, _ESTIMATES)
        was = moving.select("grp", "start", F.struct(*[c for c in params.columns if c not in ("grp", "start")]).alias("was"))
        met = materialise(step.join(was, ["grp", "start"]).withColumn("fall", F.col("was.log_det") - F.col("log_det")), "mcd-step")
        # a step that doesn't lower the determinant isn't taken
        still = met.filter(F.col("fall") < LEAST_FALL)
        ended = ended.unionByName(still.filter("fall > 0").select(params.columns)).unionByName(still.filter("fall <= 0").select("grp", "start", "was.*"))
        moving = met.filter(F.col("fall") >= LEAST_FALL).select(params.columns)
        if moving.isEmpty():
            break
    params = materialise(ended, "mcd-ended")
    best = params.groupBy("grp").agg(F.min_by(F.struct("centre", "scatter"), F.struct("log_det", "start")).alias("p")).select("grp", "p.*")
    fits = materialise(_with_wider(sizes.select("level", "grp", "wider", "total").join(best, "grp"), ["centre", "scatter"]).mapInPandas(_inverted, "level int, grp string, wider string, total long, centre array<double>, scatter array<double>, inverse array<double>"), "mcd-fits")
    placed = fits.select("grp", "centre", "inverse", F.lit(0).alias("start"))
    median = _below(long, sizes, placed, 0.5, []).groupBy("grp").agg(F.max("bucket").alias("b"))
    median = median.select("grp", F.array(F.log(F.greatest(F.exp((F.col("b") + 0.5) / BUCKETS) - 1, F.lit(1e-3)) / CHI2_MEDIAN)).alias("log_factor"))
    scaled = _with_wider(fits.drop("scatter").join(median, "grp"), ["log_factor"]).filter("level = 2")
    shown = sizes.select("grp", "lang", "source")
    return materialise(scaled.join(shown, "grp").select("lang", "source", "centre", "inverse", F.exp(F.col("log_factor")[0]).alias("factor")), "mcd-fit")


def _with_wider(fits: DataFrame, arrays: list[str]) -> DataFrame:
    """fits (level, grp, wider, total, ...) whose arrays are means: a group's own counts its rows, that of the wider
    group, itself such a mean, PRIOR_ROWS."""
    done = out = fits.filter("level = 0")
    for level in (1, 2):
        prior = done.select(F.col("grp").alias("_g"), *[F.col(c).alias(f"_{c}") for c in arrays])
        done = fits.filter(F.col("level") == level).join(prior, F.col("wider") == F.col("_g"))
        mean = lambda c: F.zip_with(c, f"_{c}", lambda own, wide: (F.col("total") * own + PRIOR_ROWS * wide) / (F.col("total") + PRIOR_ROWS))
        done = done.withColumns({c: mean(c) for c in arrays}).select(fits.columns)
        out = out.unionByName(done)
    return out


def _below(long: DataFrame, sizes: DataFrame, params: DataFrame, share: float, moments: list[Column]) -> DataFrame:
    """Distance buckets of each group and start up to the one in which `share` of the rows is reached."""
    placed = long.select("grp", *[f"v{i}" for i in range(_P)]).join(params, "grp").withColumn("bucket", F.floor(F.log1p(_distance()) * BUCKETS).cast("int"))
    counted = placed.groupBy("grp", "start", "bucket").agg(*(moments or [F.count("*").alias("n")]))
    before = F.sum("n").over(Window.partitionBy("grp", "start").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    return counted.withColumn("before", F.coalesce(before, F.lit(0))).join(sizes.select("grp", "total"), "grp").filter(F.col("before") < F.ceil(F.col("total") * share))


def _concentrate(long: DataFrame, sizes: DataFrame, params: DataFrame) -> DataFrame:
    core = _below(long, sizes, params, CORE_SHARE, _moments())
    return core.groupBy("grp", "start").agg(F.sum("n").alias("n"), *(F.sum(s).alias(s) for s in _SUMS))


_GRID = np.linspace(-14.0, 40.0, 27_001)


def f_quantile(share: float, freedom: float) -> float:
    """A quantile of the F distribution with seven and `freedom` degrees of freedom, from its density over logarithms."""
    density = np.exp(_P / 2 * _GRID - (_P + freedom) / 2 * np.log1p(_P / freedom * np.exp(_GRID)))
    below = np.cumsum(density)
    return float(np.exp(np.interp(share, below / below[-1], _GRID)))


def _freedom(ratio: float, shares: tuple[float, float]) -> float:
    """The degrees of freedom at which two quantiles have this ratio, which falls as they rise; from 1/2 to 200."""
    low, high = 0.5, 200.0
    for _ in range(40):
        middle = (low * high) ** 0.5
        if f_quantile(shares[1], middle) / f_quantile(shares[0], middle) > ratio:
            low = middle
        else:
            high = middle
    return low


def fitted_cut(counts: list[tuple[int, int]]) -> float:
    """The cut from a histogram of scaled squared distances over logarithmic buckets (bucket, n). The freedom is first
    fitted to the core, then to what each cut keeps, until the cut stays."""
    at = np.array([(b + 0.5) / BUCKETS for b, _ in counts])
    n = np.array([float(n) for _, n in counts])
    scale = CHI2_MEDIAN / f_quantile(0.5, PRIOR_FREEDOM)
    prior = np.log([scale * f_quantile((k + 0.5) / PRIOR_ROWS, PRIOR_FREEDOM) for k in range(PRIOR_ROWS)])
    at, n = np.concatenate([at, prior]), np.concatenate([n, np.ones(PRIOR_ROWS)])
    order = np.argsort(at, kind="stable")
    at, n = at[order], n[order]
    cut, shares = np.inf, CORE_QUANTILES
    for _ in range(20):
        inside = np.exp(at) <= cut
        below = (np.cumsum(n[inside]) - n[inside] / 2) / n[inside].sum()
        low, high = (float(np.exp(np.interp(q, below, at[inside]))) for q in shares)
        freedom = _freedom(high / low, shares)
        before, cut = cut, low * f_quantile(CUT_SHARE, freedom) / f_quantile(0.5, freedom)
        if abs(cut - before) * BUCKETS < cut:
            break
        shares = TAIL_QUANTILES
    return float(cut)


def quality_rules(docs: DataFrame, key: str = "doc_id", cut: float | None = None) -> DataFrame:
    """docs: key, text, lang, source. Returns per row: key, lang, source, the base figures, base_failed, distance, kept.
    cut: the largest distance that stays; none: fitted to the distances of this run.

    Null or empty text: zeros, base_failed (distance null). Null lang or source: a group of its own. A group of few rows
    leans on its language's estimate, and that on the estimate of all rows; a single row is its own centre. Repeated
    rows count each. Empty table: no rows. Further columns of docs are ignored."""
    stats = materialise(text_statistics(docs.select(F.col(key).alias("doc_id"), "lang", "source", "text"), ["doc_id", "lang", "source"]), "quality-stats")
    stats = stats.select("*", base_failed().alias("base_failed"), *(c.alias(n) for n, c in _vector().items()))
    usable = stats.filter(~F.col("base_failed")).withColumn("u", F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(1 << 20)))
    fit = fit_mcd(usable.select("lang", "source", "u", *[f"v{i}" for i in range(_P)]))
    distance = F.when(~F.col("base_failed"), _distance() / F.col("factor"))
    judged = materialise(salted_left_join(stats, fit, ["lang", "source"]).select("doc_id", "lang", "source", *STATS, "base_failed", distance.alias("distance")), "quality-judged")
    if cut is None:  # the buckets are a few thousand, whatever the input
        buckets = judged.filter("distance > 0").groupBy(F.floor(F.log("distance") * BUCKETS).cast("int").alias("b")).agg(F.count("*").alias("n"))
        cut = fitted_cut([tuple(r) for r in buckets.orderBy("b").collect()])
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= cut, F.lit(True))
    return judged.select(F.col("doc_id").alias(key), "lang", "source", *STATS, "base_failed", "distance", kept.alias("kept"))


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("distance", 3).alias("distance"))
