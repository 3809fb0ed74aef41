"""Renames against all pairs; the memo computes what is new only, once."""

import random
from threading import Thread

from pyspark.sql import functions as F

from tallyloom.operators import renames
from tallyloom.sources.memo import Memo, digest


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_renames_are_those_of_all_pairs(spark):
    rng = random.Random(8)
    name = lambda: "".join(rng.choice("abAB_é") for _ in range(rng.randrange(1, 11)))
    old, new = [(rng.randrange(3), name()) for _ in range(250)], [(rng.randrange(3), name()) for _ in range(250)]
    targets = [(0, old[0][1].upper()), (1, new[1][1])]
    want = set()
    for k, a in set(old):
        for j, b in set(new):
            if j != k or (k, a) in new or (j, b) in old or {(k, a.lower()), (k, b.lower())} & {(t, n.lower()) for t, n in targets}:
                continue
            far = distance(a.lower(), b.lower())
            if a.lower() == b.lower():
                want.add((k, a, b, "case_rename", None))
            elif far <= 2 and min(len(a), len(b)) >= 4:
                want.add((k, a, b, "near_rename", far))
    frame = lambda rows, c: spark.createDataFrame(rows, f"k int, {c} string")
    found = renames.renames(frame(old, "old"), frame(new, "new"), ["k"], frame(targets, "name"))
    assert {tuple(r) for r in found.collect()} == want and len(want) > 100


def test_few_candidates_of_long_names(spark):
    rng = random.Random(9)
    names = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20)) for _ in range(3000)]
    old = spark.createDataFrame([(1, n) for n in names], "k int, old string")
    new = spark.createDataFrame([(1, n[:5] + "_" + n[7:]) for n in names], "k int, new string")
    assert renames.candidates(old, new, ["k"]).count() < 3 * len(names)
    assert renames.renames(old, new, ["k"]).count() == len(names)


def test_memo(spark, tmp_path, rows):
    memo = Memo(spark, f"{tmp_path}/m", "n bigint, run int")
    compute = lambda run: lambda x: x.select("key", F.length(F.coalesce("a", F.lit("-"))).cast("long").alias("n"), F.lit(run).alias("run"))
    df = lambda *a: spark.createDataFrame([(i, x) for i, x in enumerate(a)], "i int, a string")
    rows(memo.through(df("x", "x", None, ""), ["a"], compute(1)).select("i", "n", "run"), (0, 1, 1), (1, 1, 1), (2, 1, 1), (3, 0, 1))
    rows(memo.through(df("x", "yy", None), ["a"], compute(2)).select("i", "n", "run"), (0, 1, 1), (1, 2, 2), (2, 1, 1))
    assert memo.entries().count() == 4 and memo.entries().filter("run = 2").count() == 1
    memo.evict(keep=1)
    rows(memo.entries().select("n", "run"), (2, 2))
    rows(memo.through(df("x", "yy"), ["a"], compute(3)).select("i", "run"), (0, 3), (1, 2))
    memo.evict(since=F.lit("2100-01-01").cast("timestamp"))
    assert memo.entries().count() == 0


def test_concurrent_writers_agree(spark, tmp_path):
    """Four writers put the same keys at once, with results of their own: one of them counts for all readers."""
    memo = Memo(spark, f"{tmp_path}/m", "n int")
    keys = spark.range(20).select(digest("id").alias("key"))
    now = F.lit("2024-01-01").cast("timestamp")
    threads = [Thread(target=lambda n=n: memo.put(keys.withColumn("n", F.lit(n)), now)) for n in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    first, again = ({(r.key, r.n) for r in memo.entries().collect()} for _ in range(2))
    assert first == again and len(first) == 20 and len({n for _, n in first}) == 1
    assert len({r.key for r in spark.createDataFrame([("a", "b"), ("ab", ""), ("", "ab"), (None, "ab"), ("ab", None)], "x string, y string").select(digest("x", "y").alias("key")).collect()}) == 5
