"""Queries of clusters of causes, and of sources that fail one by one."""

from pyspark.sql import functions as F

from tallyloom.operators import clusters
from tallyloom.plans.adapters import edges, findings, with_views
from tallyloom.plans.folders import shared_folder
from tallyloom.plans.registry import query
from tallyloom.sources import tools
from tallyloom.sources.registry import Sources

#: Files as nodes of the edges: nations, a few suppliers and customers with one finding or none, and files that nothing depends on.
NODES = "CASE WHEN part < 3 THEN concat('c', seq % 9) WHEN part = 3 AND seq % 7 = 0 THEN concat('s', seq % 9973 % 400) WHEN part = 4 THEN concat('n', seq % 4) WHEN part = 5 THEN concat('x', seq) ELSE concat('y', seq % 50) END"


@query("a9_cascade_union", with_views("findings", "edges", body=f"""+ff AS (SELECT {NODES} AS file, seq FROM findings), per AS (SELECT file, count(*) AS n, min(seq) AS first FROM ff GROUP BY file),
ps AS (SELECT e.dst AS file, e.src AS dependent, a.n + b.n AS n, a.first AS fa, b.first AS fb FROM edges e JOIN per a ON a.file = e.dst JOIN per b ON b.file = e.src),
cl AS (SELECT 0 AS k, file, NULL AS dependent, n, first AS fa, NULL AS fb FROM per WHERE n > 1 UNION ALL SELECT 1, file, dependent, n, fa, fb FROM ps UNION ALL SELECT 2, file, NULL, n, first, NULL FROM per WHERE n = 1 AND file NOT IN (SELECT file FROM ps) AND file NOT IN (SELECT dependent FROM ps)),
o AS (SELECT *, row_number() OVER (ORDER BY k, fa, file, fb, dependent) AS r FROM cl), mb AS (SELECT r, file AS member FROM o UNION SELECT r, dependent FROM o WHERE dependent IS NOT NULL),
fc AS (SELECT member, min(r) AS r FROM mb GROUP BY member), sm AS (SELECT fc.r, sum(per.n) AS claimed FROM fc JOIN per ON per.file = fc.member GROUP BY fc.r)
SELECT CASE k WHEN 0 THEN 'file' WHEN 1 THEN 'dependents' ELSE 'single' END AS kind, o.file, o.dependent, o.n, coalesce(sm.claimed, 0)::BIGINT AS claimed FROM o LEFT JOIN sm ON sm.r = o.r"""))
def a9_union(spark, d):
    rows = findings(spark, d).selectExpr(f"{NODES} AS file", "seq")
    return clusters.cascade_clusters(rows, edges(spark, d)).select("kind", "file", "dependent", "n", "claimed")


@query("s1_isolated_sources", with_views("findings", body="SELECT tool, count(*) AS n, count(DISTINCT file) AS files, true AS ok FROM findings WHERE tool IN ('mypy', 'ruff') GROUP BY tool UNION ALL SELECT 'broken', 0, 0, false UNION ALL SELECT 'odd', 0, 0, false"))
def s1_isolated(spark, d):
    """Four sources: two logs that are written and read back, one whose reader fails, one whose rows fail as they are read."""
    f, path = findings(spark, d), shared_folder(spark, "logs")
    line = F.concat("file", F.lit(":"), F.col("line").cast("string"), F.lit(":"), F.col("col").cast("string"), F.lit(": error: "), "message", F.lit("  [x]"))
    for t in ("mypy", "ruff"):
        f.filter(F.col("tool") == t).select(line.alias("value")).write.text(f"{path}/{t}")
    sources = Sources()

    def broken(spark, place):
        raise OSError(place)

    sources.register("mypy", lambda spark, place: tools.parse_text(spark.read.text(place), "mypy"))
    sources.register("broken", broken)
    sources.register("odd", lambda spark, place: spark.read.text(place).select(F.raise_error(F.lit("row")).alias("file")))
    sources.register("ruff", lambda spark, place: tools.parse_text(spark.read.text(place), "mypy"))
    rows, status = sources.collect(spark, {n: f"{path}/{'ruff' if n == 'odd' else n}" for n in ("mypy", "broken", "odd", "ruff")})
    per = rows.groupBy("tool").agg(F.count("*").alias("n"), F.count_distinct("file").alias("files"))
    return status.join(per, "tool", "left").select("tool", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("files", F.lit(0)).alias("files"), "ok")
