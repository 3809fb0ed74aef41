"""First-wins dedup, unions and set operations over findings.  Order is explicit (a sequence column), so results do not depend on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def first_wins(df: DataFrame, key: list[Column], order: list[str]) -> DataFrame:
    """The first row of each key in the given order.  Null-safe; the per-partition prefix of the group limit is taken before the shuffle."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).filter("_n = 1").drop("_n")


def union_sources(sources: dict[str, DataFrame]) -> DataFrame:
    """Bag union of named sources, in order, with their name and rank; columns that a source lacks are null."""
    out = None
    for rank, (name, df) in enumerate(sources.items()):
        df = df.withColumns({"tool": F.lit(name), "tool_rank": F.lit(rank)})
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def dedup_findings(df: DataFrame, order: list[str]) -> DataFrame:
    """One finding per (file, line, message), missing ones as empty or 0."""
    return first_wins(df, [F.coalesce("file", F.lit("")), F.coalesce("line", F.lit(0)), F.coalesce("message", F.lit(""))], order)


def compare_sets(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """Each distinct key with its side: new, lost or common, by one aggregation over the tagged union."""
    both = before.select(*key, F.lit(1).alias("b"), F.lit(0).alias("a")).unionByName(after.select(*key, F.lit(0).alias("b"), F.lit(1).alias("a")))
    return both.groupBy(*key).agg(F.max("b").alias("b"), F.max("a").alias("a")).select(*key, F.when(F.col("b") == 0, "new").when(F.col("a") == 0, "lost").otherwise("common").alias("side"))


def replace_files(old: DataFrame, fresh: DataFrame, files: DataFrame) -> DataFrame:
    """Old findings of files that were not scanned again, and the fresh ones of those that were."""
    return old.join(files, "file", "left_anti").unionByName(fresh.join(files, "file", "left_semi"))


def append_new(rows: DataFrame, existing: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Rows whose key is not there yet, the first of each key; nulls are equal to each other."""
    first = first_wins(rows, [F.col(k) for k in key], order)
    seen = existing.select(*[F.col(k).alias(f"_{k}") for k in key]).distinct()
    same = F.lit(True)
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return first.join(seen, same, "left_anti")


def dedup_lines(df: DataFrame, text: str = "text") -> DataFrame:
    """Each document's distinct lines in order of their first place."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    return df.withColumn(text, F.array_join(F.array_distinct(lines), "\n"))
