"""Run statistics, error statistics and label counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def filled(*columns: str, default: str) -> Column:
    """The first column that is not null or empty."""
    return F.coalesce(*[F.when(F.col(c) != "", F.col(c)) for c in columns], F.lit(default))


def error_stats(df: DataFrame, weight: str) -> DataFrame:
    """Count, sum, mean, least and greatest weight by type, by severity, by file, and in all (``kind`` tells which)."""
    rows = df.select(filled("error_type", default="unknown").alias("type"), filled("severity", default="unknown").alias("severity"), F.coalesce("file", F.lit("")).alias("file"), F.col(weight).alias("w"))
    numbers = [F.count("*").alias("n"), F.sum("w").alias("total"), F.avg("w").alias("mean"), F.min("w").alias("least"), F.max("w").alias("most")]
    grouped = rows.groupingSets([["type"], ["severity"], ["file"]], "type", "severity", "file").agg(F.grouping_id().alias("_g"), *numbers)
    # the total is an aggregation of its own: it has a row even if there are no findings
    grouped = grouped.unionByName(rows.agg(F.lit(7).cast("long").alias("_g"), *numbers), allowMissingColumns=True)
    kind = F.when(F.col("_g") == 3, "type").when(F.col("_g") == 5, "severity").when(F.col("_g") == 6, "file").otherwise("all")
    return grouped.select(kind.alias("kind"), F.coalesce("type", "severity", "file", F.lit("")).alias("value"), "n", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("total", "mean", "least", "most")])


def compare_counts(before: DataFrame, after: DataFrame, key: Column, name: str = "value") -> DataFrame:
    """after - before per key over the union of keys, by one signed aggregation."""
    both = before.select(key.alias(name), F.lit(-1).alias("n")).unionByName(after.select(key.alias(name), F.lit(1).alias("n")))
    return both.groupBy(name).agg(F.sum("n").alias("delta"))


def counts(df: DataFrame, key: Column, name: str) -> DataFrame:
    return df.groupBy(key.alias(name)).agg(F.count("*").alias("n"))


def run_summary(df: DataFrame, key: list[str]) -> DataFrame:
    """KPIs of each run's decisions: by outcome, symbol regressions, mean confidence over known ones, share accepted of the judged (null if none)."""
    is_ = lambda v: F.count_if(F.col("decision") == v)
    judged = is_("ACCEPT") + is_("REJECT") + is_("NEEDS_REVIEW")
    return df.groupBy(*key).agg(
        F.count("*").alias("decisions"), is_("ACCEPT").alias("accepted"), is_("REJECT").alias("rejected"), is_("NEEDS_REVIEW").alias("needs_review"),
        F.count_if("symbol_regression").alias("symbol_regressions"), F.count("confidence").alias("with_confidence"), F.avg("confidence").alias("mean_confidence"),
        (is_("ACCEPT") / F.nullif(judged, F.lit(0))).alias("accept_share"),
    )


def run_kpis(runs: DataFrame, decisions: DataFrame, key: list[str]) -> DataFrame:
    """The KPIs of each run: its own counters, what they say of each other, and its decisions' counts.

    runs: key, ``initial_errors, final_errors, scan_before, scan_after`` and any further counters, which are kept
    (timeouts, rollbacks, stop reason ...).  fixed_percent is 0 without initial errors; scan_delta is null unless both scans
    are there.  Values are counted per key first, so no group of decisions is gathered.
    """
    is_ = lambda c, v: F.col(c) == v
    rebuilt = is_("patch_source", "syntax_reconstruction")
    numbers = decisions.groupBy(*key).agg(
        F.count("*").alias("decisions"), F.count_if("symbol_regression").alias("symbol_regressions"), F.count_distinct(F.when(is_("decision", "ACCEPT"), F.col("file"))).alias("accepted_files"), F.count_distinct(F.when(is_("decision", "REJECT"), F.col("file"))).alias("rejected_files"),
        F.count_if(is_("decision", "NEEDS_REVIEW")).alias("needs_review"), F.count_if(rebuilt).alias("reconstruction_attempts"), F.count_if(rebuilt & is_("decision", "FAILED")).alias("reconstruction_failed"),
    )

    def by(column: str, name: str, rows: DataFrame) -> DataFrame:
        each = rows.filter(F.col(column) != "").groupBy(*key, F.col(column).alias("v")).agg(F.count("*").alias("n"))
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("v", "n"))), lambda x: F.concat(x["v"], F.lit("="), x["n"].cast("string"))), ",")
        return each.groupBy(*key).agg(joined.alias(name))

    initial, fixed = F.col("initial_errors"), F.col("initial_errors") - F.col("final_errors")
    out = runs.withColumns({"fixed": fixed, "fixed_percent": F.when(initial == 0, 0.0).otherwise(F.round(100.0 * fixed / initial, 1)), "scan_delta": F.col("scan_before") - F.col("scan_after"), "duration_seconds": F.round("duration_seconds", 1)}).join(numbers, key, "left")
    names = {"by_outcome": ("decision", decisions), "by_source": ("patch_source", decisions), "by_verdict": ("review_verdict", decisions), "reconstruction_outcomes": ("decision", decisions.filter(rebuilt))}
    for name, (column, rows) in names.items():
        out = out.join(by(column, name, rows), key, "left")
    return out.na.fill("", list(names)).na.fill(0, ["decisions", "symbol_regressions", "accepted_files", "rejected_files", "needs_review", "reconstruction_attempts", "reconstruction_failed"])


def project_outcome(accepted: Column, needs_review: Column, findings: Column, failed: Column) -> tuple[Column, Column]:
    """FAIL, EMPTY, PARTIAL or PASS, and the score 2 * accepted + needs_review / 2, plus 1 or minus 3."""
    outcome = F.when(failed, "FAIL").when(findings == 0, "EMPTY").when(accepted == 0, "PARTIAL").otherwise("PASS")
    return outcome, 2 * accepted + 0.5 * needs_review + F.when(failed, -3).otherwise(1)


def carried_verdicts(lines: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Log lines ``kind, code, source, value``: each verdict or rejection with the code and source of the last patch line before it.

    A verdict or rejection ends the patch, so only the first one after a patch line gets it.
    """
    from pyspark.sql import Window as W

    w = W.partitionBy(*key).orderBy(*order)
    patch = F.col("kind") == "patch"
    df = lines.withColumn("_p", F.sum(F.when(patch, 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    inside = W.partitionBy(*key, "_p").orderBy(*order)
    ended = F.sum(F.when(F.col("kind").isin("verdict", "reject"), 1).otherwise(0)).over(inside.rowsBetween(W.unboundedPreceding, -1))
    df = df.withColumns({"_code": F.first(F.when(patch, F.col("code")), ignorenulls=True).over(inside.rowsBetween(W.unboundedPreceding, 0)), "_source": F.first(F.when(patch, F.col("source")), ignorenulls=True).over(inside.rowsBetween(W.unboundedPreceding, 0)), "_ended": F.coalesce(ended, F.lit(0))})
    live = (F.col("_p") > 0) & (F.col("_ended") == 0)
    return df.withColumns({"code": F.when(live, F.col("_code")), "source": F.when(live, F.col("_source"))}).filter(F.col("kind").isin("verdict", "reject")).drop("_p", "_code", "_source", "_ended")


def progress(before: DataFrame, after: DataFrame, files: DataFrame) -> DataFrame:
    """Findings ``before`` and ``after`` in some files, by one aggregation of both scans; null without any finding there."""
    both = before.select("file", F.lit(1).alias("b"), F.lit(0).alias("a")).unionByName(after.select("file", F.lit(0).alias("b"), F.lit(1).alias("a")))
    return both.join(files.select("file").distinct(), "file", "left_semi").agg(F.sum("b").alias("before"), F.sum("a").alias("after"))


def success_rate(df: DataFrame, key: list[str], value: Column, accepted: Column) -> DataFrame:
    """Mean value of the accepted rows of each key, 1 at most; 0.5 for keys without any."""
    return df.groupBy(*key).agg(F.coalesce(F.least(F.avg(F.when(accepted, value)), F.lit(1.0)), F.lit(0.5)).alias("rate"))


def merge_counters(parts: DataFrame, key: list[str], count: str) -> DataFrame:
    """Counters that parallel workers have kept from one common start: the highest of each key."""
    return parts.groupBy(*key).agg(F.max(count).alias(count))


def merge_lists(base: DataFrame, parts: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Rows that parallel workers have added beyond a common base, after it: rows of the base once, others as often as they were added; ``place`` is the new order."""
    from pyspark.sql import Window as W

    added = parts.join(base.select(*key).distinct(), key, "left_anti")
    rows = base.withColumn("_new", F.lit(0)).unionByName(added.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return rows.withColumn("place", F.row_number().over(W.partitionBy(key[0]).orderBy("_new", *order))).drop("_new")


def patch_cap(df: DataFrame, accepted: Column, most: int = 30) -> DataFrame:
    """Files that have had ``most`` accepted patches or more, with their number."""
    return df.filter(accepted).groupBy("file").agg(F.count("*").alias("n")).filter(F.col("n") >= most)


def decision_integrity(df: DataFrame, rejected: Column, counted: Column) -> DataFrame:
    """Rejections in the log, those that the counter has, and whether the rows that it passes over explain the gap."""
    g = df.agg(F.count_if(rejected).alias("log"), F.count_if(rejected & counted).alias("counter"), F.count_if(rejected & ~counted).alias("gap"))
    return g.select("log", "counter", (F.col("log") - F.col("counter") == F.col("gap")).alias("explained"))


def infrastructure_failures(failures: DataFrame, runs: DataFrame, key: list[str]) -> DataFrame:
    """Per run: failures of the infrastructure in all, and by category as "category=n" in order; runs without any have 0 and nothing."""
    per = failures.groupBy(*key, F.coalesce("category", F.lit("")).alias("c")).agg(F.count("*").alias("n"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c", "n"))), lambda x: F.concat(x["c"], F.lit("="), x["n"].cast("string"))), ",")
    return runs.select(*key).distinct().join(per.groupBy(*key).agg(F.sum("n").alias("failures"), text.alias("by_category")), key, "left").na.fill(0, ["failures"]).na.fill("", ["by_category"])


def audit_counts(audits: DataFrame, key: list[str]) -> DataFrame:
    """Per run: files whose audits have all passed, and files with one that has not."""
    files = audits.groupBy(*key, "file").agg(F.bool_and("passed").alias("p"))
    return files.groupBy(*key).agg(F.count_if("p").alias("passed"), F.count_if(~F.col("p")).alias("failed"))


def recent_rates(df: DataFrame, key: list[str], order: list[str], rates: dict[str, tuple[Column, Column]], most: int = 10) -> DataFrame:
    """Rates over the last ``most`` rows up to each row: share of the rows of the second condition that are of the first; null without such rows."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*key).orderBy(*order).rowsBetween(1 - most, 0)
    share = lambda a, b: F.sum((a & b).cast("int")).over(w) / F.nullif(F.sum(b.cast("int")).over(w), F.lit(0))
    return df.withColumns({n: share(a, b) for n, (a, b) in rates.items()})


def series_summary(projects: DataFrame) -> DataFrame:
    """One row over projects with their outcome: how many there are of each, the share that passed, and the findings of all; null share without projects."""
    of = lambda o: F.count_if(F.col("outcome") == o)
    return projects.agg(F.count("*").alias("projects"), of("PASS").alias("passed"), of("PARTIAL").alias("partial"), of("FAIL").alias("failed"), of("EMPTY").alias("empty"), F.round(of("PASS") / F.nullif(F.count("*"), F.lit(0)), 3).alias("rate"), F.coalesce(F.sum("findings"), F.lit(0)).alias("findings"))
