"""Queries of source trees and dumps of runs, written to the shared folder and read back."""

from pyspark.sql import functions as F

from tallyloom.plans.adapters import decisions, table, with_views
from tallyloom.plans.folders import shared_folder
from tallyloom.plans.registry import query
from tallyloom.sources import sinks, tools


@query("s16_source_files", "SELECT CASE doc_id % 3 WHEN 0 THEN 'src' ELSE 'deep' END AS folder, sum(length(coalesce(text, '')) + 1)::BIGINT AS letters, sum(length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) + 1)::BIGINT AS lines FROM documents WHERE doc_id % 3 <> 1 GROUP BY 1")
def s16(spark, d):
    """All documents as files of a tree; what lies below a skipped folder, or has another ending, is not read."""
    docs, path = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("value")), shared_folder(spark, "tree")
    for rest, folder in enumerate(("src", "node_modules/src", "lib/deep")):
        docs.filter(F.col("doc_id") % 3 == rest).select("value").write.text(f"{path}/{folder}")
    docs.select("value").limit(1).write.json(f"{path}/other")
    files = tools.read_sources(spark, path, (".txt",))
    folder = F.element_at(F.split("file", "/"), -2)
    return files.groupBy(folder.alias("folder")).agg(F.sum(F.length("text")).alias("letters"), F.sum(F.size(F.split("text", "\n")) - 1).alias("lines"))


@query("k2_run_dump", with_views("decisions", body="SELECT count(*) AS decisions, count(*) FILTER (WHERE decision = 'ACCEPT') AS accepted, 2::BIGINT AS runs, count(*) + count(*) FILTER (WHERE seq % 2 = 0) AS of_all_runs, concat('| decisions | ', count(*), ' |') AS line FROM decisions"))
def k2(spark, d):
    """Two runs with one folder: the dump is that of the last one, the log has both."""
    path, rows = shared_folder(spark, "dump"), decisions(spark, d)
    summary = lambda part: part.agg(F.count("*").alias("decisions"), F.count_if(F.col("decision") == "ACCEPT").alias("accepted"))
    sinks.run_dump(summary(rows.filter("seq % 2 = 0")), path, "first")
    text = sinks.run_dump(summary(rows), path, "second")
    schema = "decisions long, accepted long"
    log = spark.read.schema(schema).json(f"{path}/runs").agg(F.count("*").alias("runs"), F.sum("decisions").alias("of_all_runs"))
    return spark.read.schema(schema).json(f"{path}/run").join(F.broadcast(log)).withColumn("line", F.lit(next(x for x in text.split("\n") if "decisions" in x)))
