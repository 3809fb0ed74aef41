"""Ranked search against plain Python: one score for each item and document."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from conftest_llm import DIR, UPPER
from oracle import connect, same
from pyspark.sql import functions as F

from tallyloom.llm import queries, search


def terms(text):
    return Counter(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(UPPER)))


def brute(docs, items, most=50, once=True, length=50):
    """[(item_id, rank, doc_id, score)] of (doc_id, text) and (item_id, text) pairs; items may be repeated."""
    docs = [(d, terms(x)) for d, x in docs]
    sizes = [sum(t.values()) for _, t in docs]
    n, total = sum(1 for s in sizes if s), sum(sizes)
    df = Counter(w for _, t in docs for w in t)
    wanted = {}
    for i, x in items:
        wanted.setdefault(i, Counter()).update(terms(x))
    out = []
    for i, t in wanted.items():
        found = []
        for (d, have), size in zip(docs, sizes):
            score = 0
            for w, times in t.items():
                if tf := have.get(w, 0):
                    m = 100 - length + length * size * n // total
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (1000000000 * tf // (1000 * tf + 20 * m)) * (1 if once else times)
            if score > 0:
                found.append((-score, d is not None, d or 0, d))
        out += [(i, rank, f[3], -f[0]) for rank, f in enumerate(sorted(found)[:most], 1)]
    return sorted(out, key=str)


def got(df):
    assert dict(df.dtypes)["rank"] == "int" and dict(df.dtypes)["score"] == "bigint"
    return sorted((tuple(r[c] for c in ("item_id", "rank", "doc_id", "score")) for r in df.collect()), key=str)


def pairs(df):
    return [tuple(r) for r in df.collect()]


def test_sql(spark):
    same(queries.QUERIES["op11_lexical_search"](spark, DIR), connect(DIR).sql(queries.ORACLES["op11_lexical_search"]))


@pytest.mark.parametrize("once", [True, False])
def test_blocks(spark, docs, once, monkeypatch):
    """Many blocks of items and of documents, and repeated terms of items."""
    for name, value in (("ITEM_TERMS", 60), ("DOCS", 7), ("ENTRIES", 500), ("SALTS", 3)):
        monkeypatch.setattr(search, name, value)
    items = spark.read.parquet(f"{DIR}/benchmark.parquet").select("item_id", F.concat_ws(" ", "text", "text", F.substring("text", 1, 30)).alias("text")).limit(8).cache()
    found = search.search(docs.repartition(5), items, most=9, once=once)
    assert got(found) == brute(pairs(docs.select("doc_id", "text")), pairs(items), 9, once)


def test_odd(spark, odd, none):
    items = odd.select(F.when(F.col("doc_id") % 5 > 0, F.col("doc_id") % 5).alias("item_id"), "text", F.lit(1).alias("rank"), F.lit("x").alias("score"))
    rows = pairs(odd.select("doc_id", "text"))
    assert got(search.search(odd, items)) == brute(rows, pairs(items.select("item_id", "text")))
    assert got(search.search(odd, items, most=1)) == brute(rows, pairs(items.select("item_id", "text")), 1)
    assert search.search(none, items).count() == search.search(odd, none, item_id="doc_id").count() == 0
    named = search.search(odd, odd.select(F.col("token").alias("name"), F.lit("same ONE").alias("said")), item_id="name", item_text="said")
    assert {(r.item_id, r.doc_id) for r in named.collect()} == {("t", 3), ("t", 4), ("t", 13), ("t", 14), (None, 3), (None, 4), (None, 13), (None, 14)}


def test_ties_and_hot_documents(spark):
    """Thousands of equal documents under few ids: the smallest ids first, a null before all, repeated rows ranked each."""
    docs = spark.range(3000).select(F.when(F.col("id") > 1, F.col("id") % 1000).alias("doc_id"), F.lit("alpha beta").alias("text")).unionByName(spark.range(3000).select((F.col("id") + 5000).alias("doc_id"), F.lit("gamma").alias("text")))
    items = spark.createDataFrame([(1, "beta")], "item_id int, text string")
    found = [(r.doc_id, r.rank) for r in search.search(docs.repartition(16), items, most=7).orderBy("rank").collect()]
    assert found == [(None, 1), (None, 2), (0, 3), (0, 4), (1, 5), (1, 6), (2, 7)]


def test_long_lengths():
    """Lengths times documents beyond 64 bits."""
    block = search.Block({"ids": np.arange(2).tobytes(), "sizes": np.array([10**12, 5]).tobytes(), "terms": np.array([0, 0], "<i4").tobytes(), "places": np.array([0, 1], "<i4").tobytes(), "times": np.array([3, 1]).tobytes()})
    n, total = 10**11, 3 * 10**14
    want = [2000 * (10**9 * tf // (1000 * tf + 20 * (50 + 50 * size * n // total))) for tf, size in ((3, 10**12), (1, 5))]
    assert search.impacts(block, np.array([2000]), n, total, 50).tolist() == want
