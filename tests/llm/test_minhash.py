"""Near-duplicates: sketches against their bounds, components against all pairs."""

import random
from collections import defaultdict

import numpy as np
import pytest
from conftest_llm import DIR, words
from pyspark.sql import functions as F

from tallyloom.llm import minhash, queries
from tallyloom.llm.textscan import mix


def shingles(text, size):
    w = words(text)
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def brute(rows, size, num, den):
    """{doc_id: (n_shingles, component_id, kept)} of (doc_id, text) pairs with different ids."""
    sets = {d: shingles(t, size) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    for d, s in sets.items():
        both = defaultdict(int)
        for x in s:
            for o in holders[x]:
                if o < d:
                    both[o] += 1
        for o, k in both.items():
            if den * k >= num * (len(s) + len(sets[o]) - k):
                a, b = sorted((find(d), find(o)))
                parent[b] = a
    return {d: (len(s), find(d), find(d) == d) for d, s in sets.items()}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def test_documents(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = queries.QUERIES["op13_minhash"](spark, DIR)
    assert found.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert got(found) == brute(rows, 3, 85, 100)
    assert got(minhash.near_duplicates(docs.repartition(7))) == brute(rows, 5, 80, 100)


def test_sketches_fill_and_agree():
    """Every coordinate of any set fills, equal sets agree, and the share that agrees keeps to the similarity's bounds."""
    rng = np.random.Generator(np.random.PCG64(5))
    new = lambda n: mix(rng.integers(0, 2**63, n, dtype=np.uint64))
    for n in (1, 2, 7, 100, 216, 3000):
        a = new(n)
        one, again, none = minhash.sketches([np.sort(a), np.sort(a)[::-1], np.zeros(0, np.uint64)], 216)
        assert (one == again).all() and not none.any()
        assert np.count_nonzero(one) >= 205  # a byte is zero by chance only
        for share in (0.3, 0.85):
            both = new(round(n * 2 * share / (1 + share)))
            sets = [np.concatenate((both, new(n - len(both)))) for _ in range(2)]
            true = len(both) / (2 * n - len(both))
            for coordinates in (64, 1024):
                x, y = minhash.sketches(sets, coordinates)
                assert abs((x == y).mean() - true) <= 5 * (true * (1 - true) / coordinates) ** 0.5 + (1 if n < 7 else 0.01)


def test_sketches_of_one_element_have_all_rounds():
    (row,) = minhash.sketches([np.array([7], np.uint64)], 50)
    assert len(set(row.tolist())) > 38  # each bin has the hash of its own round


@pytest.mark.parametrize("hot", [False, True])
def test_stars_and_chains(spark, hot):
    """Copies of one text that are alike to it but not to each other, a chain of versions, and texts that share a passage only."""
    rng = random.Random(3)
    text = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows, stem = [], text(400)
    for _ in range(400 if hot else 40):  # each copy replaces a passage of its own
        at, copy = rng.randrange(380), list(stem)
        copy[at : at + 14] = text(14)
        rows.append(copy)
    rows.insert(len(rows) // 2, stem)
    link = text(300)
    for _ in range(30):
        link = link[6:] + text(6)
        rows.append(link)
    passage = text(60)
    rows += [passage + text(rng.randrange(20, 90)) for _ in range(60)]
    rows += [[], ["one"], ["one", "two"], ["ONE", "Two"]] + [stem] * 20
    rng.shuffle(rows)
    rows = [(1000 + 3 * i, " ".join(x)) for i, x in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    want = brute(rows, 3, 85, 100)
    assert got(minhash.near_duplicates(docs, words=3, num=85)) == want
    assert max(sum(1 for x in want.values() if x[1] == c) for c in {x[1] for x in want.values()}) > (200 if hot else 30)


def test_odd(spark, odd, none):
    """Nulls, empty and long texts, repeated rows and ids: brute force on rows of one id each; the rest as stated."""
    found = minhash.near_duplicates(odd)
    assert found.count() == odd.count()
    single = {r.doc_id: r for r in found.filter("doc_id IS NOT NULL").collect()}
    want = brute([(r.doc_id, r.text) for r in odd.filter("doc_id IS NOT NULL").distinct().collect()], 5, 80, 100)
    assert {d: (r.n_shingles, r.component_id, r.kept) for d, r in single.items()} == want
    assert {(r.n_shingles, r.component_id, r.kept) for r in found.filter("doc_id IS NULL").collect()} == {(1, None, True), (0, None, True)}
    assert minhash.near_duplicates(none).count() == 0
    same = spark.range(3000).select(F.lit(4).alias("doc_id"), F.lit("a text that is the same in all rows").alias("text"))
    assert set(map(tuple, minhash.near_duplicates(same).collect())) == {(4, 5, 4, True)}  # nine words
    with pytest.raises(ValueError):
        minhash.near_duplicates(odd, bands=5000)
