"""A memo table: results by the digest of what they were computed from, shared by all runs that use its folder.

Each put is a folder of its own, so writers never meet; of results with one key the earliest counts, so all readers agree.  Eviction writes
the entries that stay as a new generation, which a manifest names; readers go on with the old one until then.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyloom.sources.snapshots import Snapshots


def digest(*columns: str) -> Column:
    """Key of the contents of columns: nulls, empty strings and different splits of the same letters have different keys."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in columns]), {"ignoreNullFields": "false"}), 256)


class Memo:
    """Entries ``key, saved_at, writer`` and the columns of results, below a folder of a file system that all share."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), f"key string, saved_at timestamp, writer string, {schema}"
        self.store = Snapshots(spark, f"{self.path}/generations")

    def _generation(self) -> int:
        return (self.store.steps() or [0])[-1]

    def entries(self) -> DataFrame:
        """One entry a key: the earliest, among equal times that of the least writer."""
        base = [self.store.read(g).tables["entries"] for g in self.store.steps()[-1:]]
        folder = f"{self.path}/puts/{self._generation()}"
        at, fs = self.store._at(folder)
        if fs.exists(at) and fs.listStatus(at):
            base.append(self.spark.read.schema(self.schema).option("recursiveFileLookup", True).parquet(folder))
        rows = base[0] if base else self.spark.createDataFrame([], self.schema)
        for more in base[1:]:
            rows = rows.unionByName(more)
        names = [c for c in rows.columns if c not in ("key", "saved_at", "writer")]
        first = rows.groupBy("key").agg(F.min_by(F.struct("saved_at", "writer", *names), F.struct("saved_at", "writer")).alias("e"))
        return first.select("key", "e.*")

    def put(self, results: DataFrame, now: Column | None = None) -> None:
        """Add results: ``key`` and their columns."""
        stamp = F.current_timestamp() if now is None else now
        name = uuid4().hex
        results.withColumns({"saved_at": stamp, "writer": F.lit(name)}).write.parquet(f"{self.path}/puts/{self._generation()}/{name}")

    def through(self, rows: DataFrame, columns: list[str], compute: Callable[[DataFrame], DataFrame], now: Column | None = None) -> DataFrame:
        """rows with their results: those that are known by the contents of columns, the others computed once for each content, put, and read back.

        compute: from distinct ``key`` and columns to ``key`` and the results.
        """
        keyed = rows.withColumn("key", digest(*columns))
        missing = keyed.select("key", *columns).dropDuplicates(["key"]).join(self.entries().select("key"), "key", "left_anti")
        self.put(compute(missing), now)
        return keyed.join(self.entries().drop("saved_at", "writer"), "key", "left")

    def evict(self, keep: int | None = None, since: Column | None = None) -> None:
        """Keep the ``keep`` entries that were saved last (ties by key), of those saved since a time; puts that come meanwhile are computed again later."""
        rows = self.entries()
        if since is not None:
            rows = rows.filter(F.col("saved_at") >= since)
        if keep is not None:
            rows = rows.orderBy(F.desc("saved_at"), "key").limit(keep)
        self.store.publish(self._generation() + 1, ["evicted"], {"entries": rows})
