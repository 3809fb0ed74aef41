"""Sources of findings by name, each read for itself: one that fails is told and left out, the others' rows stay."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyloom.plans.folders import shared_folder

#: What every source gives; columns that one lacks are null, others go.
FINDING = "file string, line int, code string, message string, severity string"


class Sources:
    """Readers ``(spark, place) -> DataFrame`` by name, in the order of their registration."""

    def __init__(self, schema: str = FINDING):
        self.schema, self.readers = schema, {}

    def register(self, name: str, read: Callable[[SparkSession, str], DataFrame]) -> None:
        if name in self.readers:
            raise ValueError(f"{name} is registered already")
        self.readers[name] = read

    def collect(self, spark: SparkSession, places: dict[str, str]) -> tuple[DataFrame, DataFrame]:
        """All rows with ``tool`` and ``tool_rank`` (place in the order of registration), and ``tool, ok, rows, error`` of each source that was asked for.

        A source is run to its end and written before the next one, so a fault shows there, in its plan or in its rows, and takes
        nothing else with it.
        """
        unknown = sorted(set(places) - set(self.readers))
        if unknown:
            raise ValueError(f"no such sources: {', '.join(unknown)}")
        columns, folder = self.schema.split(", "), shared_folder(spark, "sources")
        wanted = spark.createDataFrame([], f"{self.schema}, tool string, tool_rank int")
        status, parts = [], []
        for rank, (name, read) in enumerate(self.readers.items()):
            if name not in places:
                continue
            try:
                found = read(spark, places[name])
                casts = [f"CAST({c.split()[0] if c.split()[0] in found.columns else 'NULL'} AS {c.split()[1]}) AS {c.split()[0]}" for c in columns]
                path = f"{folder}/{rank}"
                found.selectExpr(*casts, f"'{name}' AS tool", f"{rank} AS tool_rank").write.parquet(path)
                parts.append(path)
                status.append((name, True, spark.read.parquet(path).count(), None))
            except Exception as e:  # of one source, whatever it is
                logging.getLogger(__name__).exception("source %s failed", name)
                status.append((name, False, 0, type(e).__name__))
        rows = spark.read.schema(wanted.schema).parquet(*parts) if parts else wanted
        return rows, spark.createDataFrame(status, "tool string, ok boolean, rows long, error string")
