"""Dependency graphs as edge tables: neighbours, closures, depth and impact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyloom.plans.folders import shared_folder


def dependents(edges: DataFrame) -> DataFrame:
    """Per node: how many nodes point to it (each edge counted) and the distinct ones in order."""
    return edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("src")), ",").alias("dependents"))


def reach(edges: DataFrame, starts: DataFrame, forward: bool = False, most_steps: int = 1024) -> DataFrame:
    """``start, node, depth`` of every node that is reached against (or along) the edges, the start itself at depth 0.

    Semi-naive fix point: each step joins only the new frontier; cycles end because known pairs are dropped.  The result
    has a row for each start and node that it reaches, so ask for the starts that are needed.  Each step is written to the
    shared folder, which cuts the lineage.  Chains longer than most_steps are an error, not a shorter result.
    """
    a, b = ("src", "dst") if forward else ("dst", "src")
    spark = edges.sparkSession
    out = shared_folder(spark, "reach")
    e = written(edges.select(F.col(a).alias("node"), F.col(b).alias("next")).distinct(), shared_folder(spark, "reach-edges"))
    frontier = written(starts.select(F.col("node").alias("start"), "node", F.lit(0).alias("depth")).distinct(), f"{out}/step=0")
    for depth in range(1, most_steps + 1):
        known = spark.read.schema(frontier.schema).parquet(*[f"{out}/step={k}" for k in range(depth)])
        found = frontier.join(e, "node").select("start", F.col("next").alias("node")).distinct().join(known, ["start", "node"], "left_anti").withColumn("depth", F.lit(depth))
        frontier = written(found.select("start", "node", "depth"), f"{out}/step={depth}")
        if frontier.isEmpty():
            return known
    raise RuntimeError("a chain is longer than most_steps")


def written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def chain_score(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """Per start: how many nodes depend on it, directly or not, itself included."""
    return reach(edges, starts).groupBy(F.col("start").alias("node")).agg(F.count("*").alias("score"))


def cascade_score(edges: DataFrame, weights: DataFrame) -> DataFrame:
    """Per weighted node: sum of the weights of the other weighted nodes that depend on it."""
    r = reach(edges, weights).filter("start <> node")
    w = weights.select("node", "weight")
    return weights.select("node").join(r.join(w, "node").groupBy(F.col("start").alias("node")).agg(F.sum("weight").alias("cascade")), "node", "left").select("node", F.coalesce("cascade", F.lit(0.0)).alias("cascade"))


# Files and folders whose change is critical.
CRITICAL_FILES = ("Cargo.toml", "Cargo.lock", "package.json", "package-lock.json", "pyproject.toml", "requirements.txt", "tsconfig.json", "main.rs", "lib.rs", "mod.rs", "__init__.py", "main.py", "index.js", "index.ts")
CRITICAL_FOLDERS = ("config", "settings", "migrations", "auth")


def critical_path(path: Column) -> Column:
    """Whether a path's file, or a folder or file on it, is critical."""
    parts = F.split(path, "/")
    return F.element_at(parts, -1).isin(*CRITICAL_FILES) | F.arrays_overlap(parts, F.array(*[F.lit(x) for x in CRITICAL_FOLDERS]))


def impact(edges: DataFrame, starts: DataFrame, size: Column | int = 0) -> DataFrame:
    """Per start: blast radius (direct dependents), greatest depth, and 0.3 ln(b + 1) + 0.2 depth + criticality.

    Criticality is 0.5 for a critical start, half as much again if the patch is larger than 50 lines; size may use columns of starts.
    """
    r = reach(edges, starts.select("node"))
    out = r.groupBy(F.col("start").alias("node")).agg(F.count_if(F.col("depth") == 1).alias("radius"), F.max("depth").alias("depth"))
    size = F.lit(size) if isinstance(size, int) else size
    critical = F.when(critical_path(F.col("node")), F.when(size > 50, 0.75).otherwise(0.5)).otherwise(0.0)
    out = out.join(starts.select("node", critical.alias("criticality")).distinct(), "node")
    return out.withColumn("impact", 0.3 * F.log(F.col("radius") + 1.0) + 0.2 * F.col("depth") + F.col("criticality"))


def missing(names: DataFrame, *known: DataFrame, catalogue: DataFrame | None = None) -> DataFrame:
    """Names that none of the known tables has; with a catalogue, only those that it lists."""
    out = names.select("name").distinct()
    for k in known:
        out = out.join(k.select("name").distinct(), "name", "left_anti")
    return out if catalogue is None else out.join(catalogue, "name")


def unused_verdict(kind: Column, reasons: Column, mode: str = "safe") -> Column:
    """What to do with an unused symbol: public ones are unsure, imports safe, ones with side effects suppressed; the rest by mode."""
    public = F.exists(reasons, lambda r: F.lower(r).contains("public") | F.lower(r).contains("export"))
    effects = F.arrays_overlap(reasons, F.array(F.lit("side_effect"), F.lit("unsafe_remove")))
    return F.when(public, "unsure").when(kind.isin("import", "module"), "safe").when(effects, "safe" if mode == "aggressive" else "suppress").otherwise("safe" if mode in ("smart", "aggressive") else "suppress")
