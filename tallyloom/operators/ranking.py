"""Weights, order and selection of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tallyloom.functions.rules import SEVERITY_WEIGHT, STRUCTURAL_CODES, class_weight, live, lookup, protected


def rank(df: DataFrame, priority: str = "priority") -> DataFrame:
    """Place of each finding by priority, highest first, in the old order on ties; a missing priority comes from the severity."""
    p = F.coalesce(F.col(priority), lookup(F.coalesce("severity", F.lit("")), SEVERITY_WEIGHT, 0.0))
    return df.withColumn("rank_priority", p)


def prioritize(df: DataFrame, fixable: DataFrame | None = None, known: DataFrame | None = None, error_class: str = "error_class") -> DataFrame:
    """Weight of each finding: an unclosed quote 9999; else its class's, at least 95 if a rule fixes it in live code, at least 98 if a fix is known."""
    weight = class_weight(F.col(error_class))
    if fixable is not None:
        df = df.join(F.broadcast(fixable.select("code").distinct().withColumn("_fix", F.lit(True))), "code", "left")  # the rule table: one row per rule
        weight = F.when(F.coalesce("_fix", F.lit(False)) & live(F.col("file")), F.greatest(weight, F.lit(95.0))).otherwise(weight)
    if known is not None:
        df = df.join(known.select("signature").distinct().withColumn("_known", F.lit(True)), "signature", "left")
        weight = F.when(F.coalesce("_known", F.lit(False)), F.greatest(weight, F.lit(98.0))).otherwise(weight)
    return df.withColumn("weight", F.when(F.col("code") == "E0765", 9999.0).otherwise(weight)).drop("_fix", "_known")


def order_by_weight(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("weight"), F.translate("file", "\\", "/"), F.coalesce("line", F.lit(0)), "code", "seq")


def drop_banned(df: DataFrame, banned: DataFrame) -> DataFrame:
    """Findings whose file, line and code are not banned."""
    return df.join(banned.select("file", "line", "code").distinct(), ["file", "line", "code"], "left_anti")


def drop_toxic(df: DataFrame, toxic: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Findings without the non-structural ones of toxic files, and how many were skipped per file."""
    structural = (F.coalesce("error_class", F.lit("")) == "CRITICAL_SYNTAX") | F.coalesce("code", F.lit("")).isin(*STRUCTURAL_CODES)
    files = toxic.select("file").distinct()
    skipped = df.filter(~structural).join(files, "file", "left_semi").groupBy("file").agg(F.count("*").alias("skipped"))
    kept = df.filter(structural).unionByName(df.filter(~structural).join(files, "file", "left_anti"))
    return kept, skipped


def clusters(df: DataFrame, priority: str = "priority") -> DataFrame:
    """Per file: findings, sum and maximum of priority; no file is <unknown>, no priority is 1."""
    p = F.when(F.coalesce(F.col(priority), F.lit(0.0)) == 0, 1.0).otherwise(F.col(priority))
    file = F.when(F.coalesce("file", F.lit("")) == "", "<unknown>").otherwise(F.translate("file", "\\", "/"))
    return df.groupBy(file.alias("file")).agg(F.count("*").alias("n"), F.sum(p).alias("total_priority"), F.max(p).alias("max_priority"))


def unprotected(df: DataFrame) -> DataFrame:
    """Findings of unprotected files; all, if there are none."""
    flagged = df.withColumn("_p", protected(F.coalesce("file", F.lit(""))))
    some = flagged.agg(F.min(F.col("_p").cast("int")).alias("_all"))  # one row
    return flagged.join(F.broadcast(some), (F.col("_all") == 1) | ~F.col("_p")).drop("_p", "_all")


def root_cause(df: DataFrame, cascade: DataFrame, priority: str = "priority") -> DataFrame:
    """The finding to fix first: in the best file by (highest priority, total with cascade, name), the one of the highest priority and line, first on ties."""
    scored = clusters(df, priority).join(cascade, "file", "left").withColumn("score", F.struct("max_priority", F.col("total_priority") + F.coalesce("cascade", F.lit(0.0)), "file"))
    best = scored.agg(F.max("score").alias("_best")).select(F.col("_best.file").alias("_file"))  # one row
    rows = df.join(F.broadcast(best), F.col("file") == F.col("_file"))
    return rows.orderBy(F.desc(F.coalesce(priority, F.lit(0.0))), F.desc("line"), "seq").limit(1).drop("_file")


def top(df: DataFrame, key: list[str], n: int, order: list[Column]) -> DataFrame:
    """The first n rows of each key; the limit is also taken before the shuffle."""
    return df.withColumn("place", F.row_number().over(W.partitionBy(*key).orderBy(*order))).filter(F.col("place") <= n)


def nearest_match(anchors: DataFrame, lines: DataFrame, window: int = 15) -> DataFrame:
    """Per anchor ``id, file, line, match``: the nearest line of the file with that text within the window, else the only one in the file.

    Anchors and lines are reduced to distinct places first, which are put in order within (file, text).  The nearest line before a place and the one
    after it come from windows that run once in each direction, so no pairs are formed; the one join gives each anchor what its place has found.
    """
    there = (F.col("file").isNotNull()) & F.col("match").isNotNull()  # null is equal to nothing
    at = lines.select("file", F.col("text").alias("match"), "line").filter(there).withColumn("n", F.lit(1))
    places = at.unionByName(anchors.select("file", "match", "line").filter(there).withColumn("n", F.lit(0))).groupBy("file", "match", "line").agg(F.sum("n").alias("n"))
    key = W.partitionBy("file", "match")
    held = F.when(F.col("n") > 0, F.col("line"))
    upto = lambda order: F.last(held, ignorenulls=True).over(key.orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    places = places.select("file", "match", "line", upto(F.asc("line")).alias("before"), upto(F.desc("line")).alias("after"), F.sum("n").over(key).alias("k"), F.min(held).over(key).alias("only"))
    down, up = F.col("line") - F.col("before"), F.col("after") - F.col("line")
    near = F.when((down <= window) & (up.isNull() | (down <= up)), F.struct(down.alias("gap"), F.col("before").alias("at"))).when(up <= window, F.struct(up.alias("gap"), F.col("after").alias("at")))
    places = places.select(F.col("file").alias("_file"), F.col("match").alias("_match"), F.col("line").alias("_line"), near.alias("near"), "k", "only")
    hits = anchors.join(places, (F.col("file") == F.col("_file")) & (F.col("match") == F.col("_match")) & F.col("line").eqNullSafe(F.col("_line")), "left")
    best = hits.groupBy("id").agg(F.min("near").alias("near"), F.sum("k").alias("k"), F.min("only").alias("only"), F.count("*").alias("anchors"))
    found = F.when(F.col("near").isNotNull(), F.col("near.at")).when(F.col("k") == 1, F.col("only"))
    return best.select("id", found.alias("found"), F.explode(F.sequence(F.lit(1).cast("long"), "anchors"))).select("id", "found")


def drop_noisy_files(df: DataFrame, codes, most: int) -> DataFrame:
    """Findings without any of files that have ``most`` or more of the given codes."""
    noisy = df.groupBy("file").agg(F.count_if(F.col("code").isin(*codes)).alias("_k")).filter(F.col("_k") >= most)
    return df.join(noisy.select("file"), "file", "left_anti")
