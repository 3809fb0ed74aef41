"""Clusters of findings that one cause may lie behind."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

KINDS = ("file", "dependents", "single")


def cascade_clusters(findings: DataFrame, edges: DataFrame) -> DataFrame:
    """``kind, file, dependent, n, claimed``: what may belong together.

    A file with several findings is a cluster; a file and each of its dependents, if both have findings, are another; a finding whose file is in
    none of these is one by itself.  n: findings of a cluster; claimed: those that it takes first, in the order of kinds, then of the file's and the
    dependent's first finding, so claims add up to all findings.  findings: ``file, seq``; edges: ``src`` depends on ``dst``.
    """
    per = findings.groupBy("file").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    of = lambda s: per.select(F.col("file").alias(s), F.col("n").alias(f"n_{s}"), F.col("first").alias(f"first_{s}"))
    row = lambda kind, file, dependent, n, a, b: [F.lit(kind).alias("kind"), F.col(file).alias("file"), dependent.alias("dependent"), n.alias("n"), F.col(a).alias("_a"), b.alias("_b")]
    none, nothing = F.lit(None).cast("string"), F.lit(None).cast(per.schema["first"].dataType)
    pairs = edges.select(F.col("dst").alias("f"), F.col("src").alias("d")).distinct().join(of("f"), "f").join(of("d"), "d")
    met = pairs.select(F.col("f").alias("file")).unionByName(pairs.select(F.col("d").alias("file"))).distinct()
    found = per.filter("n > 1").select(*row(0, "file", none, F.col("n"), "first", nothing))
    found = found.unionByName(pairs.select(*row(1, "f", F.col("d"), F.col("n_f") + F.col("n_d"), "first_f", F.col("first_d"))))
    found = found.unionByName(per.filter("n = 1").join(met, "file", "left_anti").select(*row(2, "file", none, F.col("n"), "first", nothing)))
    place = F.struct("kind", "_a", "file", "_b", F.coalesce("dependent", F.lit("")).alias("dependent"))
    member = found.select(place.alias("at"), F.explode(F.array_compact(F.array_distinct(F.array("file", "dependent")))).alias("file"))
    claims = member.groupBy("file").agg(F.min("at").alias("at")).join(per, "file").groupBy("at").agg(F.sum("n").alias("claimed"))
    claims = claims.select(F.col("at.kind").alias("kind"), F.col("at.file").alias("file"), F.nullif(F.col("at.dependent"), F.lit("")).alias("dependent"), "claimed")
    same = (found["kind"] == claims["kind"]) & (found["file"] == claims["file"]) & found["dependent"].eqNullSafe(claims["dependent"])
    name = F.element_at(F.array(*map(F.lit, KINDS)), found["kind"] + 1)
    return found.join(claims, same, "left").select(name.alias("kind"), found["file"], found["dependent"], found["n"], F.coalesce("claimed", F.lit(0)).alias("claimed"))
