"""Queries of patches of several files, codes of findings without one, and figures of runs."""

from pyspark.sql import functions as F

from tallyloom.operators import patches, stats
from tallyloom.plans.adapters import decisions, table, with_views
from tallyloom.plans.registry import query

#: Which of the two files of a patch is asked for, and by what name; part 4 asks for none of them.
ASKED = "CASE p_partkey % 5 WHEN 0 THEN 'src/a.py' WHEN 1 THEN 'a.py' WHEN 2 THEN '/repo/lib/src/b.py' WHEN 3 THEN 'src\\\\b.py' ELSE 'c.py' END"


@query("p16_changed_lines_of_files", """SELECT p_partkey AS id, unnest(CASE WHEN p_partkey % 5 < 2 THEN [p_size + 1, p_size + 2, p_size + 4, 1000 + p_size] WHEN p_partkey % 5 < 4 THEN CASE WHEN p_size % 2 = 0 THEN [7, 8] ELSE [7] END ELSE [] END)::BIGINT AS line FROM part""")
def p16_files(spark, d):
    n = lambda k: (F.col("p_size") + k).cast("string")
    a = F.concat(F.lit("--- a/src/a.py\n+++ b/src/a.py\n@@ -9,4 +"), n(0), F.lit(",5 @@\n ctx\n+one\n+two\n ctx\n-gone\n ctx\n@@ -99,2 +"), n(1000), F.lit(",3 @@ def f\n+last\n ctx\n"))
    b = F.concat(F.lit("diff --git a/src/b.py b/src/b.py\n--- a/src/b.py\n+++ b/src/b.py\n@@ -1,9 +6 @@\n ctx\n-x\n+y\n"), F.when(F.col("p_size") % 2 == 0, "+z\n ctx").otherwise("\n ctx"))
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 2 == 0, F.concat(a, b)).otherwise(F.concat(b, F.lit("\n"), a)).alias("patch"), F.expr(ASKED).alias("file"))
    return patches.changed_lines(rows)


KIND = "CASE p_partkey % 8 WHEN 0 THEN concat('heap-buffer-overflow on ', p_name) WHEN 1 THEN 'Data Race ' WHEN 2 THEN 'Indirect leak' WHEN 3 THEN concat('odd -- ', p_size, '!') WHEN 4 THEN 'new-delete-type-mismatch, double-free' WHEN 5 THEN 'SEGV' WHEN 6 THEN 'detected memory leaks' ELSE '--lock-order-inversion' END"
MESSAGE = "CASE p_partkey % 6 WHEN 0 THEN 'Cannot find implementation or library stub for x' WHEN 1 THEN 'Library stub file not found' WHEN 2 THEN 'Untyped decorator makes function f untyped' WHEN 3 THEN NULL ELSE p_name END"


@query("p33_codes", f"WITH k AS (SELECT p_partkey, {KIND} AS kind, lower({MESSAGE}) AS m FROM part) SELECT p_partkey, CASE " + " ".join(f"WHEN contains(lower(trim(kind)), '{a}') THEN '{b}'" for a, b in patches.SANITIZER_CODES.items()) + " ELSE concat('SAN_', upper(trim(regexp_replace(kind, '[^A-Za-z0-9]+', '_', 'g'), '_'))) END AS sanitizer, CASE WHEN m LIKE '%library stub%' THEN 'import-untyped' WHEN m LIKE 'untyped decorator%' THEN 'untyped-decorator' ELSE '' END AS checker FROM k")
def p33_codes(spark, d):
    return table(spark, d, "part").select("p_partkey", patches.sanitizer_code(F.expr(KIND)).alias("sanitizer"), patches.message_code(F.expr(MESSAGE)).alias("checker"))


@query("a4_infrastructure", with_views("decisions", body="""+p AS (SELECT DISTINCT project FROM decisions), c AS (SELECT project, coalesce(nullif(reason, 'guard'), '') AS c, count(*) AS n FROM decisions WHERE decision = 'FAILED' AND project < 'p3' GROUP BY 1, 2), t AS (SELECT project, sum(n) AS failures, string_agg(concat(c, '=', n), ',' ORDER BY c) AS by_category FROM c GROUP BY project),
a AS (SELECT project, file, bool_and(decision <> 'REJECT') AS ok FROM decisions GROUP BY 1, 2), b AS (SELECT project, count(*) FILTER (WHERE ok) AS passed, count(*) FILTER (WHERE NOT ok) AS failed FROM a GROUP BY project)
SELECT p.project, coalesce(t.failures, 0)::BIGINT AS failures, coalesce(t.by_category, '') AS by_category, b.passed, b.failed FROM p LEFT JOIN t ON t.project = p.project JOIN b ON b.project = p.project"""))
def a4_infrastructure(spark, d):
    rows = decisions(spark, d)
    failures = rows.filter("decision = 'FAILED' AND project < 'p3'").select("project", F.nullif("reason", F.lit("guard")).alias("category"))
    audits = rows.select("project", "file", (F.col("decision") != "REJECT").alias("passed"))
    return stats.infrastructure_failures(failures, rows, ["project"]).join(stats.audit_counts(audits, ["project"]), "project")


@query("w4_recent_rates", with_views("decisions", body="""+r AS (SELECT seq, sum((decision = 'REJECT')::INT) OVER w AS rb, count(*) OVER w AS n, sum((decision = 'ACCEPT')::INT) OVER w AS ac, sum((decision IN ('ACCEPT', 'REJECT'))::INT) OVER w AS judged, sum((patch_source = 'memory')::INT) OVER w AS mem, sum((patch_source <> '')::INT) OVER w AS pat FROM decisions WINDOW w AS (PARTITION BY project ORDER BY seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
SELECT seq, round(rb / n, 9) AS rollback, round(ac / nullif(judged, 0), 9) AS success, round(mem / nullif(pat, 0), 9) AS memory FROM r"""))
def w4_recent(spark, d):
    is_ = lambda *v: F.col("decision").isin(*v)
    rates = {"rollback": (is_("REJECT"), F.lit(True)), "success": (is_("ACCEPT"), is_("ACCEPT", "REJECT")), "memory": (F.col("patch_source") == "memory", F.col("patch_source") != "")}
    return stats.recent_rates(decisions(spark, d), ["project"], ["seq"], rates).select("seq", *[F.round(n, 9).alias(n) for n in rates])


@query("a15_series_summary", with_views("decisions", body="""+g AS (SELECT project, count(*) FILTER (WHERE decision = 'ACCEPT') AS a, sum(error_count) FILTER (WHERE user_id % 3 > 0) AS f, bool_or(seq % 4999 = 1) AS x FROM decisions GROUP BY project), o AS (SELECT coalesce(f, 0) AS f, CASE WHEN x THEN 'FAIL' WHEN coalesce(f, 0) = 0 THEN 'EMPTY' WHEN a = 0 THEN 'PARTIAL' ELSE 'PASS' END AS outcome FROM g)
SELECT count(*) AS projects, count(*) FILTER (WHERE outcome = 'PASS') AS passed, count(*) FILTER (WHERE outcome = 'PARTIAL') AS partial, count(*) FILTER (WHERE outcome = 'FAIL') AS failed, count(*) FILTER (WHERE outcome = 'EMPTY') AS empty, round(count(*) FILTER (WHERE outcome = 'PASS') / nullif(count(*), 0), 3) AS rate, sum(f)::BIGINT AS findings FROM o"""))
def a15_summary(spark, d):
    g = decisions(spark, d).groupBy("project").agg(F.count_if(F.col("decision") == "ACCEPT").alias("a"), F.coalesce(F.sum(F.when(F.col("user_id") % 3 > 0, F.col("error_count"))), F.lit(0)).alias("findings"), F.bool_or(F.col("seq") % 4999 == 1).alias("x"))
    outcome, _ = stats.project_outcome(F.col("a"), F.lit(0), F.col("findings"), F.col("x"))
    return stats.series_summary(g.withColumn("outcome", outcome))
