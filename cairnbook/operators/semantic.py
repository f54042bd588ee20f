"""Near copies of meaning: vectors whose cosine reaches a threshold.

Every asked vector meets every row, as products of blocks of bounded size, so no pair is lost. Equal vectors are one
representative. What is moved is vectors, not pairs: a row once for each block of asked vectors, an asked vector once for
each block of rows. The products stay quadratic by nature."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnbook.functions.lineage import stored

#: Vectors of a block of rows, of a block of asked ones, and those multiplied at once: what a task holds.
ROWS, ASKED, TILE = 20_000, 20_000, 256


def unit_vectors(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """rows with `unit`, the vector over its norm, and `code`, a hash of the vector that equal ones share. Rows with a
    null, empty, zero or non-finite vector fall out: they have no direction."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    kept = rows.filter(fine).withColumn("_norm", norm).filter("_norm > 0")
    return kept.withColumn("unit", F.transform(v, lambda x: x / F.col("_norm"))).withColumn("code", F.sha2(F.to_json("unit"), 256)).drop("_norm")


def _near(threshold: float):
    """Pairs (q, code, cosine) of a block of asked vectors and one of rows. Products of whole blocks find what can reach the
    threshold; the cosine of those is summed in the order of the dimensions."""

    def run(key: tuple, asked: pa.Table, rows: pa.Table) -> pa.Table:
        found = []
        a_codes, b_codes = asked.column("code").to_pylist(), rows.column("code").to_pylist()
        a, b = _matrix(asked), _matrix(rows)
        for at in range(0, len(b) if len(a) else 0, TILE):
            i, j = np.nonzero(a @ b[at : at + TILE].T >= threshold - 1e-5)
            cosine = np.zeros(len(i))
            for d in range(a.shape[1]):
                cosine += a[i, d] * b[at + j, d]
            found.extend((a_codes[x], b_codes[at + y], c) for x, y, c in zip(i.tolist(), j.tolist(), cosine.tolist(), strict=True))
        q, code, cosine = zip(*found, strict=True) if found else ((), (), ())
        return pa.table({"q": pa.array(q, pa.string()), "code": pa.array(code, pa.string()), "cosine": pa.array(cosine, pa.float64())})

    return run


def _matrix(rows: pa.Table) -> np.ndarray:
    flat = rows.column("unit").combine_chunks().flatten().to_numpy() if rows.num_rows else np.zeros(0)
    return flat.reshape(rows.num_rows, -1) if rows.num_rows else np.zeros((0, 0))


def similar_vectors(rows: DataFrame, asked: DataFrame, threshold: float = 0.9, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, object_id, cosine (six places) for all rows of `asked` and of `rows` with other keys whose cosine is
    `threshold` or more. Pairs are of distinct vectors; rows come back in at the end, so the result alone
    grows with the copies."""
    all_ = stored(unit_vectors(rows.select(key, vector), vector).select(F.col(key).alias("object_id"), "unit", "code"))
    queries = stored(unit_vectors(asked.select(key, vector), vector).select(F.col(key).alias("query_id"), "unit", "code"))
    kinds, wanted = all_.dropDuplicates(["code"]).select("code", "unit"), queries.dropDuplicates(["code"]).select("code", "unit")
    n_rows, n_asked = (max(1, -(-df.count() // size)) for df, size in ((all_, ROWS), (queries, ASKED)))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = wanted.select("code", "unit", F.size("unit").alias("dims"), block("code", n_asked).alias("i")).select("*", every(n_rows).alias("j"))
    right = kinds.select("code", "unit", F.size("unit").alias("dims"), block("code", n_rows).alias("j")).select("*", every(n_asked).alias("i"))
    met = left.groupBy("dims", "i", "j").cogroup(right.groupBy("dims", "i", "j")).applyInArrow(_near(threshold), "q string, code string, cosine double")
    near = met.withColumn("cosine", F.round("cosine", 6)).filter(F.col("cosine") >= threshold)
    out = near.join(queries.select("query_id", F.col("code").alias("q")), "q").join(all_.select("object_id", "code"), "code")
    return out.filter("query_id <> object_id").select("query_id", "object_id", "cosine")
