"""Snapshots of a whole run: several tables that are published together, and runs that take up from the newest complete one.

Below a folder, ``data`` holds the tables of each attempt to write a snapshot, and ``manifests`` one file for each complete
snapshot.  The manifest names the folder of every table and comes last, by a rename, so a snapshot is there as a whole or not at
all: what a writer that was killed has left is read by nobody and goes with ``vacuum``.  A table that a step did not change is
named again and not written again.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, types as T

from tallyloom.sources.sinks import SECRET_KEYS

#: Steps of a run: a name, and a function from the tables before to the tables after it.
Step = tuple[str, Callable[[dict[str, DataFrame]], dict[str, DataFrame]]]
REDACTED = "<redacted>"


def redacted(value):
    """value (of JSON) with the values of secret keys replaced at any depth."""
    if isinstance(value, dict):
        return {k: REDACTED if re.search(SECRET_KEYS, str(k)) else redacted(v) for k, v in value.items()}
    return [redacted(v) for v in value] if isinstance(value, (list, tuple)) else value


@dataclass
class Snapshot:
    """A complete snapshot: how many steps it follows, their names, its tables, and what else the run has noted."""

    step: int
    names: list[str]
    tables: dict[str, DataFrame]
    paths: dict[str, str]
    facts: dict


class Snapshots:
    """The snapshots below a folder of a file system that all executors share; one writer at a time, any number of readers."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _manifest(self, step: int) -> str:
        return f"{self.path}/manifests/{step:09d}.json"

    def steps(self) -> list[int]:
        """Numbers of the complete snapshots, ascending."""
        at, fs = self._at(f"{self.path}/manifests")
        names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n[:-5]) for n in names if re.fullmatch(r"\d+\.json", n))

    def read(self, step: int) -> Snapshot:
        at, fs = self._at(self._manifest(step))
        if not fs.exists(at):
            raise ValueError(f"there is no snapshot {step}")
        told = json.loads("".join(r[0] for r in self.spark.read.text(self._manifest(step), wholetext=True).collect()))  # a line for each table
        tables = {n: self.spark.read.schema(T.StructType.fromJson(t["schema"])).parquet(t["path"]) for n, t in told["tables"].items()}
        return Snapshot(step, told["names"], tables, {n: t["path"] for n, t in told["tables"].items()}, told["facts"])

    def latest(self) -> Snapshot | None:
        steps = self.steps()
        return self.read(steps[-1]) if steps else None

    def _write_table(self, df: DataFrame, path: str) -> None:
        df.write.parquet(path)

    def _write_manifest(self, text: str, path: str) -> None:
        """The file is written beside its place and renamed."""
        at, fs = self._at(f"{self.path}/manifests/.{uuid4().hex}.part")
        out = fs.create(at)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        to, _ = self._at(path)
        if fs.exists(to) or not fs.rename(at, to):
            fs.delete(at, False)
            raise ValueError(f"{path} is there already")

    def publish(self, step: int, names: list[str], tables: dict[str, DataFrame], facts: dict | None = None, before: Snapshot | None = None) -> Snapshot:
        """Write the tables and then the manifest; returns the snapshot as it is read back.  facts: of JSON, without secrets' values.

        Tables of before that come back as the same objects are not written again.
        """
        folder, told = f"{self.path}/data/{step:09d}-{uuid4().hex}", {}
        for n, df in tables.items():
            kept = before is not None and before.tables.get(n) is df
            path = before.paths[n] if kept else f"{folder}/{n}"
            if not kept:
                self._write_table(df, path)
            told[n] = {"path": path, "schema": json.loads(df.schema.json())}
        self._write_manifest(json.dumps({"step": step, "names": names, "tables": told, "facts": redacted(facts or {})}), self._manifest(step))
        return self.read(step)

    def vacuum(self, keep: int = 1) -> None:
        """Delete all but the newest ``keep`` snapshots, and tables that none of these names."""
        steps = self.steps()
        kept = [self.read(s) for s in steps[max(0, len(steps) - keep) :]]
        used = {p for s in kept for p in s.paths.values()}
        for s in set(steps) - {k.step for k in kept}:
            at, fs = self._at(self._manifest(s))
            fs.delete(at, False)
        top, fs = self._at(f"{self.path}/data")
        for folder in fs.listStatus(top) if fs.exists(top) else []:
            for table in fs.listStatus(folder.getPath()):
                if not any(p.endswith(f"/data/{folder.getPath().getName()}/{table.getPath().getName()}") for p in used):
                    fs.delete(table.getPath(), True)
            if not fs.listStatus(folder.getPath()):
                fs.delete(folder.getPath(), True)


def run(store: Snapshots, steps: list[Step], start: dict[str, DataFrame], facts: dict | None = None) -> Snapshot:
    """The snapshot after all steps: those that a complete snapshot follows already are not run again.

    A run is told by the names of its steps; a store that holds another run's snapshots is an error.  The start is
    published as snapshot 0, so a run that takes up reads what the first one read.
    """
    now = store.latest() or store.publish(0, [], start, facts)
    names = [n for n, _ in steps]
    if now.names != names[: now.step]:
        raise ValueError(f"the snapshots follow {now.names}, not {names[: now.step]}")
    for i in range(now.step, len(steps)):
        now = store.publish(i + 1, names[: i + 1], steps[i][1](dict(now.tables)), now.facts, now)
    return now
