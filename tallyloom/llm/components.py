"""Connected components by alternating large-star and small-star steps over a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyloom.llm.scratch import stash


def _star(edges: DataFrame, keep_larger: bool) -> DataFrame:
    """Each vertex links the larger (or the smaller and equal) of its neighbours to the least of them and itself."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not keep_larger:
        both = both.filter("b < a")
    least = both.groupBy("a").agg(F.min("b").alias("_m")).withColumn("_m", F.least("a", "_m"))
    joined = both.join(least, "a")
    out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("_m").alias("b")) if keep_larger else joined.select(F.col("b").alias("a"), F.col("_m").alias("b")).unionByName(least.select("a", F.col("_m").alias("b")))
    return out.filter("a <> b").distinct()


def components(links: DataFrame, most_rounds: int = 64) -> DataFrame:
    """``id, component`` for every vertex of links ``a, b`` (long): the least id that it is connected with.

    Rounds grow with the logarithm of the longest chain.  Each round is written, so lost executors cost one
    round at most.  Stars are joined by key, so large ones are split like any skewed join; no component is collected.
    """
    links = links if links.inputFiles() else stash(links, "links")
    edges = stash(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links", links)
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = mark(edges)
    for _ in range(most_rounds):
        edges = stash(_star(_star(edges, True), False), "links", edges)
        now = mark(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
