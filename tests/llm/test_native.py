"""Mixing, line dedup and fingerprints."""

import hashlib
import math

import pytest
from conftest_llm import DIR, words
from oracle import connect, same
from pyspark.sql import functions as F

from tallyloom.llm import fingerprints, line_dedup, mixing
from tallyloom.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    same(QUERIES[name](spark, DIR), connect(DIR).sql(ORACLES[name]))


@pytest.mark.parametrize("name", ["op2_mix_sources", "op4_line_dedup", "op10_fingerprints"])
def test_plans_have_no_python(spark, name):
    plan = QUERIES[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))


def targets(sizes, weights=(5, 2, 1), most=3):
    """Shares by weight; what is over a source's limit goes to the others, until none is over."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, out, open_ = sum(sizes.values()), {}, set(names)
    while open_:
        rest = total - sum(out.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > most * sizes[s]}
        if not over:
            out |= share
            break
        out |= {s: most * sizes[s] for s in over}
        open_ -= over
    return out


def test_targets_by_brute_force(docs, texts):
    rows = mixing.mix_plan(docs).collect()
    sizes = {}
    for r in rows:
        assert r.size == len(words(texts[r.doc_id]))
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    want = targets(sizes)
    taken = {}
    for r in rows:
        assert math.isclose(r.target, want[r.source], rel_tol=1e-9)
        assert r.taken <= 3 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert taken == {s: math.floor(t + 1e-9) for s, t in want.items()}


def test_mix_takes_what_the_plan_says(docs):
    plan = {r.doc_id: r.taken for r in mixing.mix_plan(docs).collect()}
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    got = {}
    for r in out.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(words(r.text))
        assert r.n_chars == len(r.text)
    assert got == {k: v for k, v in plan.items() if v or k in got}


@pytest.mark.parametrize("share", [0.05, 0.3, 0.5, 1.0, 2.0])
def test_mix_of_odd_documents(odd, share):
    """Row by row: the plan and the mixed rows hold the same words of each id and text."""
    rows = mixing.mix_plan(odd, share=share).collect()
    assert len(rows) == odd.count()
    out = mixing.mix(odd, share=share)
    assert out.columns == odd.columns
    taken, got = {}, {}
    for r in rows:
        taken[r.doc_id, r.source] = taken.get((r.doc_id, r.source), 0) + r.taken
    for r in out.collect():
        got[r.doc_id, r.source] = got.get((r.doc_id, r.source), 0) + len(words(r.text))
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in taken.items() if v}


@pytest.mark.parametrize("share", [0.1, 0.5, 0.6, 1.0])
def test_mix_of_repeated_rows(spark, share):
    rows = [(1, "w " * 10, "s", i) for i in range(6)] + [(1, "v " * 7, "s", 9), (2, "u " * 4, "s", 9), (2, None, "s", 1), (2, "", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, doc long")
    plan = sum(r.taken for r in mixing.mix_plan(df, share=share).collect())
    got = sorted((r.doc_id, r.text, r.doc) for r in mixing.mix(df, share=share).collect() if r.text)
    assert sum(len(words(t)) for _, t, _ in got) == plan == int(share * 71)
    assert got == sorted((r.doc_id, r.text, r.doc) for r in mixing.mix(df.repartition(3, "doc"), share=share).collect() if r.text)


def test_mix_of_nothing(none):
    assert mixing.mix_plan(none).count() == mixing.mix(none).count() == 0


def brute_lines(rows, least=40, docs_=5):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    order = lambda i: (i is not None, i or 0)
    held = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            held.setdefault(key(x), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= least and len(held[key(x)]) >= docs_ and i != max(held[key(x)], key=order))]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_line_dedup_by_brute_force(request, which):
    df = request.getfixturevalue(which)
    got = [tuple(r) for r in line_dedup.dedup_lines(df).select("doc_id", "n_lines", "n_dropped", "kept_text").collect()]
    want = brute_lines([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])
    assert sorted(got, key=str) == sorted(want, key=str)
    assert which == "docs" or any(w[2] for w in want)


def test_drop_frequent_lines_keeps_the_columns(odd, none):
    out = line_dedup.drop_frequent_lines(odd)
    assert out.columns == odd.columns
    assert all(r.n_chars == len(r.text) for r in out.collect())
    assert line_dedup.dedup_lines(none).count() == 0


def test_edited_texts_by_brute_force(spark, texts):
    got = {r.doc_id: r for r in QUERIES["op10_fingerprints"](spark, DIR).collect()}
    ids = sorted(texts, reverse=True)
    for i, following in zip(ids, ids[1:] + ids[:1]):
        t, half = texts[i], len(texts[i]) // 2
        edited = t[: len(t) - half] + texts[following][:half]
        assert got[i].n_chars == len(t)
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    by_text = {}
    for i, t in texts.items():
        assert by_text.setdefault(t, got[i].fingerprint) == got[i].fingerprint


def shingles(t, n=5):
    w = words(t)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_estimates_are_near_the_truth(spark, docs, texts):
    rows = fingerprints.fingerprint_with_next(docs)
    rows = rows.select("doc_id", fingerprints.resemblance(F.col("sketch"), F.col("next_sketch")).alias("r"), fingerprints.distinct_count(F.col("sketch")).alias("n"), fingerprints.containment(F.col("sketch"), F.col("next_sketch")).alias("c"), F.size("sketch").alias("k")).collect()
    ids = sorted(texts, reverse=True)
    after = dict(zip(ids, ids[1:] + ids[:1]))
    for r in rows:
        a, b = shingles(texts[r.doc_id]), shingles(texts[after[r.doc_id]])
        true = len(a & b) / len(a | b) if a | b else 1.0
        assert abs(r.r - true) < 0.2
        assert abs(r.c - (len(a & b) / len(a) if a else 1.0)) < 0.3
        assert abs(r.n - len(a)) <= (0 if len(a) < fingerprints.K else 0.45 * len(a))
        assert r.k == min(len(a), fingerprints.K)


def test_sketches_of_parts_merge(spark):
    w = [f"w{i}" for i in range(900)]
    df = spark.createDataFrame([(" ".join(w[:500]), " ".join(w[496:]), " ".join(w))], "a string, b string, whole string")
    a, b, whole = df.select(fingerprints.sketch(F.col("a")).alias("a"), fingerprints.sketch(F.col("b")).alias("b"), fingerprints.sketch(F.col("whole")).alias("w")).first()
    merged = spark.createDataFrame([(a, b)], "a array<long>, b array<long>").select(fingerprints.merge(F.col("a"), F.col("b"))).first()[0]
    assert merged == whole


def test_fingerprints_of_odd_documents(odd, none):
    rows = fingerprints.fingerprint_with_next(odd).collect()
    assert len(rows) == odd.count() and all(r.next_text is not None for r in rows)
    assert fingerprints.fingerprint_with_next(none).count() == 0
    one = fingerprints.fingerprint_with_next(odd.filter("doc_id = 3")).first()
    assert one.next_text == one.text == "one"
    ids = [r.doc_id for r in rows]
    assert ids.count(None) == 2 and ids.count(8) == 2


def test_ranges_of_scattered_ids(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", 64)
    ids = sorted({(i * i * 7919) % 100003 for i in range(500)})
    df = spark.createDataFrame([(i, f"text number {i}") for i in ids], "doc_id long, text string")
    got = {r.doc_id: r.next_text for r in fingerprints.fingerprint_with_next(df).collect()}
    down = ids[::-1]
    assert got == {i: f"text number {j}" for i, j in zip(down, down[1:] + down[:1])}
