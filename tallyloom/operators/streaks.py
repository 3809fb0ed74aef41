"""Windows over ordered steps: health, streaks, resets, stop rules.  All are partitioned by their key; none needs a global order."""

from __future__ import annotations

from math import fma

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import DoubleType


def over(key: list[str], order: list[str], start: int | None = None, end: int | None = None):
    w = W.partitionBy(*key).orderBy(*order)
    return w if start is None else w.rowsBetween(start, end)


def degrading(df: DataFrame, key: list[str], order: list[str], count: str, window: int = 5) -> DataFrame:
    """Whether the count is above the mean of those before it in a window of five; false for the first."""
    mean = F.avg(count).over(over(key, order, -(window - 1), -1))
    return df.withColumn("degrading", F.coalesce(F.col(count) > mean, F.lit(False)))


def _slope(xs: list[float], ys: list[float]) -> float | None:
    n, mx, my, both, own = 0, 0.0, 0.0, 0.0, 0.0
    for x, y in zip(xs, ys, strict=True):
        n += 1
        dx = x - mx
        mx, my = mx + dx / n, my + (y - my) / n
        both, own = fma(dx, y - my, both), fma(dx, x - mx, own)
    return (both / n) / (own / n) if own > 0 else None


@F.pandas_udf(DoubleType())
def _slopes(xs: pd.Series, ys: pd.Series) -> pd.Series:
    """The least-squares slope of each row's ys over its xs: covariance over variance by running means with fused products.

    This rounds to the bit as regr_slope of the SQL; Spark's does not, and steps that stand at a threshold are told by the last bit.
    """
    return pd.Series([_slope(x.tolist(), y.tolist()) for x, y in zip(xs, ys, strict=True)], dtype="float64")


def health(df: DataFrame, key: list[str], order: list[str], *, count: str, rollback: Column, failed: Column, accepted: Column, rejected: Column, from_memory: Column, has_patch: Column, label: str, window: int = 10) -> DataFrame:
    """Health over the last ten steps: stability, trend of the count, rollback, success and memory-hit rates, entropy of labels, and their weighted sum.

    Fewer than two steps give the defaults of a healthy start.  Entropy is divided by the log of four and may exceed 1.
    """
    w = over(key, order, -(window - 1), 0)
    one = lambda c: F.sum(F.when(c, 1).otherwise(0)).over(w)
    n = F.count("*").over(w)
    df = df.withColumn("_x", F.row_number().over(over(key, order)).cast("double"))
    total = F.sum(accepted).over(w) + F.sum(rejected).over(w)
    labels = F.collect_list(label).over(w)
    share = lambda a: F.transform(F.array_distinct(a), lambda x: F.size(F.filter(a, lambda y: y == x)) / F.size(a))
    entropy = F.aggregate(share(labels), F.lit(0.0), lambda s, p: s - p * F.log2(p)) / 2.0
    x = F.when(F.col(count).isNotNull(), F.col("_x"))
    slope = _slopes(F.collect_list(x).over(w), F.collect_list(F.col(count).cast("double")).over(w))
    few = n < 2
    pick = lambda c, default: F.when(few, F.lit(default)).otherwise(c)
    df = df.withColumns(
        {
            "stability": pick(1.0 - (one(rollback) + one(failed)) / n, 1.0),
            "trend": pick(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -F.coalesce(slope, F.lit(0.0)) / 5.0)), 0.0),
            "rollback_rate": pick(one(rollback) / n, 0.0),
            "success_rate": pick(F.when(total > 0, F.sum(accepted).over(w) / total).otherwise(1.0), 1.0),
            "memory_rate": pick(F.when(one(has_patch) > 0, one(from_memory) / F.nullif(one(has_patch), F.lit(0))).otherwise(0.0), 0.0),
            "entropy": pick(entropy, 0.0),
        }
    )
    return df.drop("_x")


def deltas(df: DataFrame, key: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Difference of each column from the step before; the first from 0."""
    w = over(key, order)
    return df.withColumns({f"{c}_delta": F.col(c) - F.coalesce(F.lag(c).over(w), F.lit(0)) for c in columns})


def streak(df: DataFrame, key: list[str], order: list[str], same: Column, name: str = "streak") -> DataFrame:
    """Length, up to each row, of the run of rows with an equal value."""
    w = over(key, order)
    df = df.withColumn("_v", same)
    df = df.withColumn("_c", F.when(F.col("_v").eqNullSafe(F.lag("_v").over(w)), 0).otherwise(1)).withColumn("_i", F.sum("_c").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return df.withColumn(name, F.row_number().over(over([*key, "_i"], order))).drop("_v", "_c", "_i")


def count_since(df: DataFrame, key: list[str], order: list[str], counted: Column, reset: Column, name: str) -> DataFrame:
    """Running count of rows since the last reset before them; a reset row itself counts 0 from there on."""
    w = over(key, order)
    df = df.withColumn("_r", F.sum(F.when(reset, 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    w = over([*key, "_r"], order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(F.when(counted & ~reset, 1).otherwise(0)).over(w)).drop("_r")


def stop_reason(df: DataFrame, key: list[str], order: list[str], *, count: str, initial: Column, accepted: str, rejected: str, elapsed: Column | None = None, max_cycles: int = 4, growth: float = 1.2, budget: float = 240.0, spike: int = 4) -> DataFrame:
    """The first rule that ends the cycles at each step, with a fixed cap.

    In order: nothing left, more than 120 % of the start, time budget, cap, growth in two cycles to above the start,
    two cycles without any change, two without progress, four rejections and no acceptance in two.
    accepted and rejected are those of the step itself.
    """
    w = over(key, order)
    df = df.withColumn("cycle", F.row_number().over(w)).withColumn("_d", F.coalesce(F.lag(count).over(w), initial) - F.col(count))
    lag = lambda c: F.lag(c).over(w)
    two = F.col("cycle") >= 2
    idle = two & (F.col(accepted) == 0) & (lag(accepted) == 0)
    reason = (
        F.when(F.col(count) == 0, "completed")
        .when((initial > 0) & (F.col(count) > initial * growth), "global_invariant")
        .when(F.lit(False) if elapsed is None else elapsed >= budget, "runtime_budget")
        .when(F.col("cycle") >= max_cycles, "max_cycles")
        .when(two & (F.col("_d") < 0) & (lag("_d") < 0) & (F.col(count) > initial), "error_growth")
        .when(idle & (F.col("_d") == 0) & (lag("_d") == 0), "plateau")
        .when(idle & (F.col("_d") <= 0) & (lag("_d") <= 0), "no_progress")
        .when(idle & (F.col(rejected) + lag(rejected) >= spike), "reject_spike")
    )
    return df.withColumn("stop_reason", reason).drop("_d")


def nth_return(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Occurrence number of each row of a key: the first return is allowed, later ones are banned."""
    return df.withColumn("occurrence", F.row_number().over(over(key, order))).withColumn("banned", F.col("occurrence") > 2)


def quarantined(blocked: DataFrame, file: str = "file", threshold: int = 3) -> DataFrame:
    """Folders with at least three blocked files below them (six for folders at the top)."""
    parts = F.split(file, "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    found = blocked.select(file).distinct().filter(F.size(parts) > 1).select(F.explode(folders).alias("folder"), file)
    counts = found.groupBy("folder").agg(F.count("*").alias("files"))
    depth = F.size(F.split("folder", "/"))
    return counts.filter(F.col("files") >= F.when(depth >= 2, threshold).otherwise(2 * threshold))
