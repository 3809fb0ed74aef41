"""Importance resampling: tries, bucket totals, weights, and the draw, against plain Python."""

import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import DIR, UPPER
from oracle import connect, same
from pyspark.sql import functions as F

from tallyloom.llm import importance, queries
from tallyloom.llm.textscan import NO_TERM, batches


def features(text, run):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))
    return [" ".join(w[i : i + k]) for k in range(1, run + 1) for i in range(len(w) - k + 1)]


def brute(docs, target, run=1, buckets=10000, percent=10, least=20, seed=2024):
    """[(doc_id, n_words, n_features, weight, score, rank)] of (doc_id, text) pairs."""
    of = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for side, texts in ((s, [x for _, x in docs]), (t, target)):
        for x in texts:
            for f in features(x, run):
                side[of(f)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t)]
    out = []
    for d, x in docs:
        f = features(x, run)
        weight = sum(gain[of(y)] for y in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(features(x, 1)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0]))
    for i, r in enumerate(able):
        r.append(i + 1 if i < len(able) * percent // 100 else None)
    return sorted((tuple(r) if len(r) == 6 else (*r, None) for r in out), key=str)


def got(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_words", "n_features", "weight", "score", "rank")) for r in df.collect()), key=str)


def test_sql(spark):
    same(queries.QUERIES["op12_importance"](spark, DIR), connect(DIR).sql(queries.ORACLES["op12_importance"]))


@pytest.mark.parametrize("run", [1, 2, 3])
def test_brute(spark, docs, run, monkeypatch):
    monkeypatch.setattr(importance, "NODES", 500)  # tries are counted out and begun anew
    monkeypatch.setattr(importance, "WALK", 5000)
    target = [r.text for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = importance.resample(docs.repartition(5), spark.read.parquet(f"{DIR}/benchmark.parquet"), run=run, percent=30)
    assert got(found) == brute(rows, target, run, percent=30)


def test_trie():
    trie = importance.Trie(97)
    ((_, _, t),) = batches(pa.array(["a b a b", "b a", None, "ÄB c"]))
    t.words(NO_TERM)
    trie.add(t, 2)
    want = np.zeros(97, np.int64)
    for x in ("a b a b", "b a", "Äb c"):
        for f in features(x, 2):
            want[zlib.crc32(f.encode()) % 97] += 1
    assert (trie.totals() == want).all()
    assert trie.size == 1 + 4 + 3  # a, b, Äb, c; a b, b a, Äb c


def test_odd(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    for target in (odd, none):
        texts = [r.text for r in target.collect()]
        assert got(importance.resample(odd, target, percent=100, least_words=1)) == brute(rows, texts, percent=100, least=1)
    assert importance.resample(none, odd).count() == 0
    assert importance.resample(odd, odd, percent=0).filter("rank IS NOT NULL").count() == 0


def test_ties(spark):
    """Rows of one doc_id and one text, a null id among them, have ranks of their own, over many ranges."""
    docs = spark.range(2000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 7).alias("doc_id"), F.lit("some words " * 12).alias("text"))
    importance_range, importance.RANGE = importance.RANGE, 100
    try:
        found = got(importance.resample(docs, docs, percent=50))
    finally:
        importance.RANGE = importance_range
    assert sorted(r[5] for r in found if r[5]) == list(range(1, 1001))
    drawn = sorted((r for r in found if r[5]), key=lambda r: r[5])
    assert drawn == sorted(drawn, key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[5]))
