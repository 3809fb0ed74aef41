"""Cascades, clusters and sources against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from tallyloom.functions.rules import MISSING_DEPENDENCY
from tallyloom.operators import cascade, clusters
from tallyloom.sources.registry import Sources


@pytest.mark.parametrize("hot", [False, True])
def test_dependency_cascade_is_the_loop(spark, hot):
    rng = random.Random(11)
    names = ["a", "ab", "abc", "abcd", "bcd", "x::y", "zz", "m", "mod"]
    rows = []
    for i in range(400):
        said = rng.sample(names, rng.randrange(0, 3))
        file = "hot" if hot and i % 3 else rng.choice(["p", "q", "", None])
        rows.append((i, file, rng.choice([None, 1, 2, 3, 4, 5, 6, 7]), rng.choice([MISSING_DEPENDENCY[0], "F821", "other"]), " ".join(f"'{n}'" for n in said) + rng.choice(["", " abcd", " mod", " q"]) if rng.random() < 0.95 else None, f"s{i}", False, "up" if rng.random() < 0.1 else None))
    df = spark.createDataFrame(rows, "seq long, file string, line int, code string, message string, sig string, is_root boolean, derived_from string")
    want = {r[0]: [r[6], r[7]] for r in rows}
    for file in {r[1] for r in rows} - {"", None}:
        group = sorted((r for r in rows if r[1] == file), key=lambda r: (r[2] or 0, r[0]))
        for r in group:
            held = [n for n in names if f"'{n}'" in (r[4] or "")]
            if want[r[0]][1] is None and r[3] in MISSING_DEPENDENCY and held:
                want[r[0]][0] = True
                for o in group:
                    if o is not r and want[o[0]][1] is None and (o[2] or 0) >= (r[2] or 0) and any(n in (o[4] or "") for n in held):
                        want[o[0]][1] = r[5]
    got = {r.seq: [r.is_root, r.derived_from] for r in cascade.dependency_cascade(df.repartition(6)).collect()}
    assert got == want and sum(x[1] is not None for x in want.values()) > 50


def test_clusters(spark):
    f = [("a", 1), ("a", 2), ("b", 3), ("c", 4), ("d", 5), ("d", 6), ("e", 7), ("f", 8)]
    e = [("b", "a"), ("b", "a"), ("c", "a"), ("c", "b"), ("z", "d"), ("f", "z"), ("e", "e")]
    found = clusters.cascade_clusters(spark.createDataFrame(f, "file string, seq long"), spark.createDataFrame(e, "src string, dst string"))
    got = sorted(map(tuple, found.collect()), key=str)
    assert got == sorted([("file", "a", None, 2, 2), ("file", "d", None, 2, 2), ("dependents", "a", "b", 3, 1), ("dependents", "a", "c", 3, 1), ("dependents", "b", "c", 2, 0), ("dependents", "e", "e", 2, 1), ("single", "f", None, 1, 1)], key=str)
    assert sum(r[4] for r in got) == len(f)
    none = spark.createDataFrame([], "file string, seq long")
    assert clusters.cascade_clusters(none, spark.createDataFrame(e, "src string, dst string")).count() == 0


def test_a_failing_source_leaves_the_others(spark):
    sources = Sources()
    rows = lambda spark, n: spark.range(int(n)).select(F.concat(F.lit("f"), "id").alias("file"), F.lit("E1").alias("code"), F.lit(1).alias("more"))
    sources.register("one", rows)
    sources.register("plan", lambda spark, place: spark.table("there_is_no_such_table"))
    sources.register("row", lambda spark, place: rows(spark, place).withColumn("line", F.raise_error(F.lit("x"))))
    sources.register("two", rows)
    sources.register("unasked", rows)
    found, status = sources.collect(spark, {"two": "3", "one": "2", "plan": "", "row": "1"})
    assert [(r.tool, r.tool_rank, r.file, r.line) for r in found.orderBy("tool_rank", "file").collect()] == [("one", 0, "f0", None), ("one", 0, "f1", None), ("two", 3, "f0", None), ("two", 3, "f1", None), ("two", 3, "f2", None)]
    assert {(r.tool, r.ok, r.rows) for r in status.collect()} == {("one", True, 2), ("plan", False, 0), ("row", False, 0), ("two", True, 3)}
    assert found.columns == ["file", "line", "code", "message", "severity", "tool", "tool_rank"]
    with pytest.raises(ValueError):
        sources.register("one", rows)
    with pytest.raises(ValueError, match="nobody"):
        sources.collect(spark, {"nobody": ""})
