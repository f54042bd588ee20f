"""Near-duplicates and components against brute force."""

from __future__ import annotations

import random
import re

import pytest

from cairnbook.llm import near_dedup
from cairnbook.llm.components import connected_components


def shingles(text, size):
    low = re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def components(links, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def expected(rows, size):
    sets = {r["doc_id"]: shingles(r["text"], size) for r in rows}
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return {d: len(s) for d, s in sets.items()}, components(links, ids)


@pytest.mark.parametrize("size", [2, 5])
@pytest.mark.parametrize("table", ["docs", "awkward"])
def test_equals_brute_force(request, table, size):
    rows = request.getfixturevalue(table)
    counts, comps = expected(rows.collect(), size)
    got = near_dedup.near_duplicates(rows, shingle_words=size).collect()
    assert len(got) == rows.count()
    for r in got:
        assert (r["n_shingles"], r["component_id"]) == (counts[r["doc_id"]], comps[r["doc_id"]])
        assert r["kept"] is (r["doc_id"] == comps[r["doc_id"]])


def test_families_near_the_threshold(spark):
    """Copies with a few edits, some linked only through others, and texts that share a long passage."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(4000)]
    base = [rng.choice(words) for _ in range(120)]
    texts = []
    for _ in range(320):
        copy = list(base)
        for k in rng.sample(range(120), rng.choice([2, 5, 8, 11, 13])):
            copy[k] = rng.choice(words)
        texts.append(" ".join(copy))
    passage = [rng.choice(words) for _ in range(60)]
    texts += [" ".join(passage + [rng.choice(words) for _ in range(rng.randint(8, 30))]) for _ in range(150)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    _, comps = expected(rows.collect(), 2)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(rows, shingle_words=2).collect()}
    assert got == comps


def test_null_keys_and_empty(spark, empty):
    rows = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (3, "a b c")], "doc_id long, text string")
    got = near_dedup.near_duplicates(rows).collect()
    assert sorted((r["component_id"] or -1, r["kept"]) for r in got) == [(-1, True), (-1, True), (3, True)]
    assert near_dedup.near_duplicates(empty).count() == 0


def test_components(spark):
    rng = random.Random(7)
    links = [(i, i + 1) for i in range(60)] + [(rng.randint(100, 400), rng.randint(100, 400)) for _ in range(150)] + [(500, k) for k in range(501, 560)] + [(9, 9), (None, 4)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {x for a, b in links if a is not None and a != b for x in (a, b)}
    assert got == components([(a, b) for a, b in links if a is not None], nodes)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_no_link_of_a_twentieth_is_lost_at_sf01(spark):
    """Ids divisible by 50 against all rows: every pair at the contract's similarity shares a component."""
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    rows = d.collect()
    sets = {r["doc_id"]: frozenset(map(hash, shingles(r["text"], 2))) for r in rows}
    component = {r["doc_id"]: r["component_id"] for r in near_dedup.op4_minhash_dedup(spark, "/root/testdata/sf0.1").select("doc_id", "component_id").collect()}
    links = 0
    for a in (i for i in sets if i % 50 == 0):
        own = sets[a]
        for b, other in sets.items():
            if a != b and own and 5 * min(len(own), len(other)) >= 4 * max(len(own), len(other)):
                same = len(own & other)
                if 100 * same >= 80 * (len(own) + len(other) - same):
                    links += 1
                    assert component[a] == component[b], (a, b)
    assert links > 100
