"""Structured Streaming over events: windows with watermarks, once-only emission, keyed state machines; each with its batch twin in operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, per_trigger: int = 1) -> DataFrame:
    """A file stream of event rows."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", per_trigger).parquet(path)


def windowed_counts(events: DataFrame, late: str = "1 hour", size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and sums by event-time window and type (an extension; the windows of the batch operators count rows)."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, late: str = "1 hour", gap: str = "30 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def once(events: DataFrame, key: list[str], late: str = "1 hour") -> DataFrame:
    """The first event of each key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(key)


def in_order(parts: Iterator[pd.DataFrame], by: str = "seq") -> pd.DataFrame:
    """All rows of a key in one batch by ``seq``: Arrow batches cut a key's rows anywhere, and in no order."""
    parts = list(parts)
    return pd.concat(parts).sort_values(by) if parts else pd.DataFrame()


def attempts(events: DataFrame, limit: int = 3) -> DataFrame:
    """Per file: attempts, longest run of one failure reason, blocked at ``limit`` equal reasons in a row; a new file hash starts over.

    events: ``file, file_hash, reason, seq``.  State: hash, attempts, last reason, streak, blocked.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seen, tries, last, streak, blocked = state.get if state.exists else ("", 0, "", 0, False)
        for row in in_order(parts).itertuples():
            if seen and seen != row.file_hash:
                tries, last, streak, blocked = 0, "", 0, False
            seen, tries = row.file_hash, tries + 1
            if row.reason:
                streak = streak + 1 if row.reason == last else 1
                last = row.reason
            blocked = blocked or streak >= limit
        state.update((seen, tries, last, streak, blocked))
        yield pd.DataFrame({"file": [key[0]], "attempts": [tries], "streak": [streak], "blocked": [blocked]})

    return events.groupBy("file").applyInPandasWithState(step, "file string, attempts long, streak long, blocked boolean", "seen string, tries long, last string, streak long, blocked boolean", "update", "NoTimeout")


def breaker(events: DataFrame, limit: int = 3) -> DataFrame:
    """Circuit breaker per ``key`` over ``key, ok, seq``: open when ``limit`` failures have come in a row; a success closes it."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        (failures,) = state.get if state.exists else (0,)
        last = -1
        for row in in_order(parts).itertuples():
            failures, last = 0 if row.ok else failures + 1, row.seq
        state.update((failures,))
        yield pd.DataFrame({"key": [key[0]], "seq": [last], "failures": [failures], "open": [failures >= limit]})

    return events.groupBy("key").applyInPandasWithState(step, "key string, seq long, failures long, open boolean", "failures long", "update", "NoTimeout")


def rescan(changes: DataFrame, scan: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, every: int = 3):
    """Findings kept up to date from a stream of changed files (``file`` and what ``scan`` needs): all files are scanned in
    every so many batches, the changed ones in the others; findings of files that are not scanned are taken over.

    path holds, per batch, the files as they are then and their findings.  A batch that is repeated after a failure reads only the
    batch before it and is written over, so results are the same.
    """
    from pyspark.sql import Window as W

    def each(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        read = lambda kind: spark.read.parquet(f"{path}/{kind}/batch={batch - 1}")
        place = W.partitionBy("file").orderBy(F.desc("seq"))
        new = rows.withColumn("_n", F.row_number().over(place)).filter("_n = 1").drop("_n")
        files = new if batch == 0 else new.unionByName(read("files").join(new.select("file"), "file", "left_anti"))
        files.write.mode("overwrite").parquet(f"{path}/files/batch={batch}")
        if batch % every == 0:
            found = scan(spark.read.parquet(f"{path}/files/batch={batch}"))
        else:
            found = scan(new).unionByName(read("findings").join(new.select("file"), "file", "left_anti"))
        found.write.mode("overwrite").parquet(f"{path}/findings/batch={batch}")

    return changes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def expire(df: DataFrame, saved_at: str, now: str, days: int) -> DataFrame:
    """Cache rows that are not older than some days."""
    return df.filter(F.col(saved_at) >= F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS"))


def append_log(events: DataFrame, path: str, checkpoint: str):
    """Append all rows that are new to a log of files, each once, and stop; a later run goes on from the checkpoint."""
    return events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def dispatch(events: DataFrame, listeners: dict, path: str, checkpoint: str):
    """Give each batch to the listeners (functions of DataFrames), in their order; what each returns is written below its name.

    A listener that fails is logged and skipped for that batch; the others still get it.  A batch that is repeated after a
    failure is written over, so results are there once.
    """
    import logging

    def each(rows: DataFrame, batch: int) -> None:
        for name, listen in listeners.items():
            try:
                listen(rows).write.mode("overwrite").parquet(f"{path}/{name}/batch={batch}")
            except Exception:  # of one listener, whatever it is
                logging.getLogger(__name__).exception("listener %s failed on batch %d", name, batch)

    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
