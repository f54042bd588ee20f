"""A small table with the awkward cases that every operator has to take."""

from __future__ import annotations

import pytest

LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(30_000))
TEXTS = [
    (0, "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf into deep woods", "en", "a", 90),
    (1, "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf into deep woods", "en", "a", 90),
    (2, "The Quick brown fox jumps over the lazy dog and runs away from the big bad wolf into dark woods", "en", "b", 90),
    (3, None, "en", "a", 0),
    (4, "", None, None, 0),
    (5, " \n\t ", "de", "b", 4),
    (6, LONG, "de", "b", len(LONG)),
    (7, "single", "de", None, 6),
    (8, "naïve café 🙂 日本語 text with odd spaces", "fr", "b", 30),
    (9, "write to jo.doe@mail.example.com or +1 (555) 010-9999, card 4111 1111 1111 1111, host 10.0.0.1 not 999.1.1.1", "fr", "a", 100),
]


@pytest.fixture(scope="session")
def awkward(spark):
    rows = spark.createDataFrame(TEXTS, "doc_id long, text string, lang string, source string, n_chars long")
    # repeated rows and extra columns whose names the operators use inside
    return rows.union(rows.filter("doc_id in (0, 3)")).selectExpr("*", "'e' as ids", "1 as size", "'x' as media", "0 as bytes", "'k' as key", "1 as _salt", "2 as grp").coalesce(3)


@pytest.fixture(scope="session")
def empty(awkward):
    return awkward.filter("false")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
