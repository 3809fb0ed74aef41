"""Line diffs of two texts by patience alignment, as joins.

A round splits what is not matched yet into gaps between the matches.  In each gap the common lines at its begin and end are matched, then those
lines that stand once on either side: a join, of which the longest sequence that ascends on both sides is kept.  The gaps between these
are the next round's, until a round finds nothing.  No step is quadratic in a text's lines, and all pairs of texts go through the rounds together.
"""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from tallyloom.functions.text import split_lines
from tallyloom.operators.graph import written
from tallyloom.plans.folders import shared_folder

PAIRS = T.ArrayType(T.StructType([T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType())]))


def ascending(places: list[int]) -> list[int]:
    """Indices of a longest ascending subsequence of distinct numbers."""
    ends: list[int] = []  # least last number of a sequence of each length, and its index
    at: list[int] = []
    before = [-1] * len(places)
    for k, x in enumerate(places):
        n = bisect_left(ends, x)
        before[k] = at[n - 1] if n else -1
        ends[n : n + 1], at[n : n + 1] = [x], [k]
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(k)
        k = before[k]
    return out[::-1]


@F.pandas_udf(PAIRS)
def _kept(pairs: pd.Series) -> pd.Series:
    """Of pairs in the order of i, a longest part that ascends in j."""
    return pd.Series([[p[k] for k in ascending([x["j"] for x in p])] for p in pairs])


def _sides(pairs: DataFrame, text: str, place: str) -> DataFrame:
    """``id, <place>, h``: lines of a column by place, from 0, with two hashes."""
    lines = pairs.select("id", F.posexplode(split_lines(F.col(text))).alias(place, "t"))
    return lines.select("id", place, F.struct(F.xxhash64("t"), F.xxhash64(F.lit(7), "t")).alias("h"))


def _open(lines: DataFrame, matched: DataFrame, place: str) -> DataFrame:
    """Lines without a match, with the number of matches before them (their gap), and their place in it from either end."""
    w, gap = W.partitionBy("id").orderBy(place), ["id", "gap"]
    rows = lines.join(matched.select("id", place, F.lit(1).alias("_m")), ["id", place], "left").withColumn("gap", F.count("_m").over(w)).filter("_m IS NULL").drop("_m")
    rows = rows.withColumns({"n": F.count("*").over(W.partitionBy(*gap)), "at": F.row_number().over(W.partitionBy(*gap).orderBy(place))})
    return rows.withColumn("back", F.col("n") - F.col("at"))


def _trimmed(a: DataFrame, b: DataFrame, key: str, order: str) -> DataFrame:
    """``id, gap, i, j, n``: lines at equal places from one end, up to the first that differ; n: lines of the shorter side."""
    b = b.select("id", "gap", key, "j", F.col("h").alias("h_b"), F.col("n").alias("n_b"))
    met = a.join(b, ["id", "gap", key]).withColumn("_x", F.sum(F.when(F.col("h") == F.col("h_b"), 0).otherwise(1)).over(W.partitionBy("id", "gap").orderBy(key)))
    return met.filter("_x = 0").select("id", "gap", "i", "j", key, F.least("n", "n_b").alias("least"))


def _round(a: DataFrame, b: DataFrame) -> DataFrame:
    """``id, i, j`` of the new matches of open lines."""
    begin = _trimmed(a, b, "at", "i")
    end = _trimmed(a, b, "back", "i")
    first = begin.groupBy("id", "gap").agg(F.count("*").alias("p"))
    # what the begin has taken is no more there for the end
    end = end.join(first, ["id", "gap"], "left").filter(F.col("back") < F.col("least") - F.coalesce("p", F.lit(0))).drop("p")
    taken = begin.select("id", "gap", "i", "j").unionByName(end.select("id", "gap", "i", "j"))
    once = lambda rows, c: rows.join(taken.select("id", c), ["id", c], "left_anti").groupBy("id", "gap", "h").agg(F.min(c).alias(c), F.count("*").alias("k")).filter("k = 1").drop("k")
    both = once(a, "i").join(once(b, "j"), ["id", "gap", "h"])
    anchors = both.groupBy("id", "gap").agg(F.array_sort(F.collect_list(F.struct(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j")))).alias("p"))
    return taken.select("id", "i", "j").unionByName(anchors.select("id", F.inline(_kept("p"))))


def hunks(pairs: DataFrame) -> DataFrame:
    """``id, tag, i1, i2, j1, j2``: what turns the lines of before into those of after: replace, delete or insert, in the manner of half-open ranges.

    pairs: ``id`` (unique) ``, before, after``; null texts have no lines.
    """
    spark, folder = pairs.sparkSession, shared_folder(pairs.sparkSession, "patience")
    a, b = (written(_sides(pairs, c, p), f"{folder}/{c}") for c, p in (("before", "i"), ("after", "j")))
    matched = spark.createDataFrame([], a.select("id", F.col("i").cast("int").alias("i"), F.col("i").cast("int").alias("j")).schema)
    number = 0
    while True:
        new = written(_round(_open(a, matched, "i"), _open(b, matched, "j")), f"{folder}/round={number}")
        if new.isEmpty():
            break
        number += 1
        matched = spark.read.schema(new.schema).parquet(*[f"{folder}/round={k}" for k in range(number)])
    size = lambda rows, name: rows.groupBy("id").agg(F.count("*").cast("int").alias(name))
    ends = pairs.select("id").join(size(a, "i"), "id", "left").join(size(b, "j"), "id", "left").na.fill(0, ["i", "j"])
    w = W.partitionBy("id").orderBy("i", "j")
    past = lambda c: F.coalesce(F.lag(c).over(w) + 1, F.lit(0))
    rows = matched.unionByName(ends.select("id", "i", "j")).select("id", past("i").alias("i1"), F.col("i").alias("i2"), past("j").alias("j1"), F.col("j").alias("j2"))
    tag = F.when(F.col("i1") == F.col("i2"), "insert").when(F.col("j1") == F.col("j2"), "delete").otherwise("replace")
    return rows.filter("i1 < i2 OR j1 < j2").select("id", tag.alias("tag"), "i1", "i2", "j1", "j2")


def near_line(found: DataFrame, places: DataFrame, near: int = 3) -> DataFrame:
    """The hunks within some lines of a place (``id, line``, from 1) of the text before."""
    at = F.col("line") - 1
    return found.join(places, "id").filter((F.col("i1") - near <= at) & (at <= F.col("i2") + near)).select(*found.columns, "line")
