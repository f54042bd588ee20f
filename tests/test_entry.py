"""The driver's contract: every registered query runs, and equals its SQL in DuckDB."""

from __future__ import annotations

import math
from collections import Counter

import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    return v.isoformat() if hasattr(v, "isoformat") else str(v)


@pytest.fixture(scope="session")
def duck(small):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return c


STORE = sorted(entry.store.ORACLE_SQL)


@pytest.mark.parametrize("name", STORE)
def test_query_equals_its_sql(spark, small, duck, name):
    df = entry.queries()[name](spark, small)
    cols = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    found = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    at = [names.index(c) for c in sorted(names)]
    assert sorted(names) == cols
    assert got == Counter(tuple(plain(r[i]) for i in at) for r in found.fetchall())


@pytest.mark.parametrize("missing", ["sentencepiece", "cairnbook.llm", "corpus_pipeline"])
def test_the_store_needs_no_training_data_part(missing):
    import subprocess
    import sys

    code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; assert set(e.store.QUERIES) <= set(e.queries()); print('pipeline' in e.queries())"
    done = subprocess.run([sys.executable, "-c", code], cwd=entry.HERE, capture_output=True, text=True, timeout=120)
    assert done.stdout.strip() == "False", done.stderr


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and {"query_id", "object_id", "score", "rank"} <= set(df.columns)


def test_human_size_of_every_document(spark, tmp_path):
    sizes = [5, 2048, 3 << 20, 5 << 30, 7 << 40, None]
    spark.createDataFrame(list(enumerate(sizes)), "doc_id long, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["size"] for r in entry.queries()["F03_human_size"](spark, str(tmp_path)).collect()}
    assert got == {0: "5 B", 1: "2.0 KB", 2: "3.0 MB", 3: "5.0 GB", 4: "7.0 TB", 5: None}
