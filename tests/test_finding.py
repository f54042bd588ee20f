"""Stems, phrases, snippets and near copies of meaning."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnbook.functions.stem import stem_word, stems
from cairnbook.operators import phrases, semantic

# The examples of the published algorithm, after all steps.
PUBLISHED = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre disabled disabl plastered plaster bled bled motoring motor sing sing conflated conflat
troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration
valenci valenc hesitanci hesit digitizer digit conformabli conform radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper
feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal
electriciti electr electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens
irritant irrit replacement replac adjustment adjust dependent depend adoption adopt homologou homolog communism commun activate activ angulariti angular homologous homolog effective effect
bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll generalizations gener oscillators oscil""".split()


@pytest.mark.parametrize("word,stem", zip(PUBLISHED[::2], PUBLISHED[1::2], strict=True))
def test_published_words(word, stem):
    assert stem_word(word) == stem


def test_what_is_no_small_latin_word_stays(spark):
    words = ["as", "s", "", "über", "x1ies", "naïves", None]
    assert spark.createDataFrame([(words,), (None,)], "w array<string>").select(stems("w")).collect() == [(words,), (None,)]


DOCS = [(1, "the cat sat on the mat the cat sat", "Cats sitting"), (2, "a cat, SAT! on", None), (3, None, "the cat"), (4, "cat", "sat on"), (5, "cats sit on mats", None)]


def hits(spark, asked, stemmed=False, title=False):
    docs = spark.createDataFrame(DOCS + DOCS[:1], "object_id int, body string, title string")
    found = phrases.phrase_hits(docs if title else docs.drop("title"), spark.createDataFrame(asked, "query_id string, phrase string"), stemmed)
    return sorted(map(tuple, found.collect()))


def test_phrases(spark):
    asked = [("a", "cat sat"), ("b", "the cat sat on the mat the cat sat"), ("c", "sat cat"), ("d", "cat zebra"), ("e", ""), ("f", None), ("g", "on")]
    assert hits(spark, asked) == [("a", 1, 1), ("a", 1, 7), ("a", 2, 1), ("b", 1, 0), ("g", 1, 3), ("g", 2, 3), ("g", 5, 2)]


def test_stemmed_phrases_and_titles(spark):
    assert hits(spark, [("a", "cat on"), ("b", "cats sit"), ("c", "cat mats sat")], stemmed=True) == [("b", 5, 0)]
    at = phrases.TITLE_AT
    assert hits(spark, [("a", "cat sit"), ("b", "on cat"), ("c", "the cat")], stemmed=True, title=True) == [("a", 1, at), ("a", 5, 0), ("c", 1, 0), ("c", 1, 6), ("c", 3, at)]


def test_snippets_take_the_densest_window(spark):
    body = "x " * 20 + "apple y y pear apple " + "z " * 30 + "apple apple apple apple apple"
    docs = spark.createDataFrame([(1, body), (2, "none here"), (3, None)], "object_id int, body string")
    results = spark.createDataFrame([("q", 1), ("q", 2), ("q", 3), ("r", 2)], "query_id string, object_id int")
    terms = spark.createDataFrame([("q", "apple"), ("q", "pear")], "query_id string, term string")
    got = {(r["query_id"], r["object_id"]): r["snippet"] for r in phrases.snippets(results, docs, terms, 6).collect()}
    assert got == {("q", 1): "...[apple] y y [pear] [apple] z...", ("q", 2): "none here", ("q", 3): "", ("r", 2): "none here"}


def test_near_copies_recall_and_exactness(spark):
    """Every planted copy at a cosine of 0.9 or more, held against all pairs."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 48))
    y = x + rng.normal(size=x.shape) * rng.uniform(0.05, 0.6, (600, 1))
    every = np.concatenate([x, y, x[:1].repeat(300, 0)])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(every)], "vec_id long, embedding array<float>")
    got = {(r["query_id"], r["object_id"]): r["cosine"] for r in semantic.similar_vectors(rows, rows.filter("vec_id % 50 = 0")).collect()}
    unit = every.astype(np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    c = unit[::50] @ unit.T
    want = {(50 * i, j): round(float(c[i, j]), 6) for i, j in zip(*np.nonzero(c >= 0.9), strict=True) if 50 * i != j}
    assert len(want) > 1000 and {*got} <= {*want} and len(got) >= 0.99 * len(want)
    assert all(abs(got[k] - want[k]) < 2e-6 for k in got)


def test_rows_without_a_direction(spark):
    rows = spark.createDataFrame([(0, [1.0, 1.0]), (1, [2.0, 2.0]), (2, [0.0, 0.0]), (3, None), (4, []), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [1.0]), (0, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert {tuple(r) for r in semantic.similar_vectors(rows, rows.filter(F.col("vec_id") == 0)).collect()} == {(0, 1, 1.0)}
