"""Writers: append-only logs, redacted snapshots, partitioned review queues, training exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SECRET_KEYS = r"(?i)(secret|token|api_?key|password|passwd|authorization|credential)"


def append_jsonl(df: DataFrame, path: str) -> None:
    """Append rows as JSON lines; the committer keeps readers from half-written files."""
    df.write.mode("append").json(path)


def redact(values: Column) -> Column:
    """A map with the values of secret keys replaced."""
    return F.transform_values(values, lambda k, v: F.when(k.rlike(SECRET_KEYS), F.lit("<redacted>")).otherwise(v))


def review_queue(df: DataFrame, path: str, category: str = "category") -> None:
    """One folder per category; each task writes its own rows, so a frequent category is no single task's, and there are as many files as tasks for each."""
    df.write.mode("overwrite").partitionBy(category).parquet(path)


def snapshots(df: DataFrame) -> DataFrame:
    """Per file: its first text before and its last text after, by sequence."""
    return df.groupBy("file").agg(F.min_by("before", "seq").alias("before"), F.max_by("after", "seq").alias("after"), F.count("*").alias("changes"))


def merge_events(df: DataFrame, project: str) -> DataFrame:
    """Patch events only (schema rows go), with the project filled in where it is missing."""
    return df.filter(F.col("_type") == "patch_event").withColumn("project_id", F.coalesce("project_id", F.lit(project)))


def export_text(df: DataFrame, path: str) -> None:
    """Rows of one string column as lines."""
    df.write.mode("overwrite").text(path)


def run_dump(summary: DataFrame, path: str, title: str) -> str:
    """Write a run's one-row summary as JSON (overwritten), append it to the log of runs, and return it as Markdown."""
    summary.write.mode("overwrite").json(f"{path}/run")
    summary.write.mode("append").json(f"{path}/runs")
    row = summary.limit(1).collect()
    values = row[0].asDict() if row else {}
    return "\n".join([f"# {title}", "", "| Figure | Value |", "|-|-|", *(f"| {k} | {'unknown' if v is None else v} |" for k, v in values.items())])
