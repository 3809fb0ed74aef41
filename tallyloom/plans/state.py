"""Queries of runs that are taken up again, and of streams with state."""

from pyspark.sql import functions as F

from tallyloom.operators.control import GOVERNED
from tallyloom.plans.adapters import decisions, table, with_views
from tallyloom.plans.folders import shared_folder
from tallyloom.plans.registry import query
from tallyloom.sources.memo import Memo
from tallyloom.sources.snapshots import Snapshots, run
from tallyloom.streaming import stateful


@query("t7_resume", with_views("decisions", body="SELECT file, count(*) AS attempts, count(*) FILTER (WHERE decision = 'ACCEPT') AS accepted, arg_max(reason, seq) AS reason, count(DISTINCT seq % 4) AS steps FROM decisions GROUP BY file"))
def t7(spark, d):
    """A run of four steps over all decisions; the third dies after one of its tables, and a second run takes up from the snapshot before it."""
    rows = decisions(spark, d).select("seq", "file", "decision", "reason")
    totals = ["count(*) AS attempts", "count_if(decision = 'ACCEPT') AS accepted", "max_by(reason, seq) AS reason", "max(seq) AS seq"]

    def step(k):
        def add(tables):
            part = rows.filter(F.col("seq") % 4 == k)
            both = tables["files"].unionByName(part.groupBy("file").agg(*map(F.expr, totals)))
            files = both.groupBy("file").agg(F.sum("attempts").alias("attempts"), F.sum("accepted").alias("accepted"), F.max_by("reason", "seq").alias("reason"), F.max("seq").alias("seq"))
            return {"log": tables["log"].unionByName(part.select("file", F.lit(k).alias("step")).distinct()), "files": files}

        return add

    class Lost(Exception):
        pass

    class Dying(Snapshots):
        def _write_table(self, df, path):
            if "/data/000000003-" in path and path.endswith("/files"):
                raise Lost
            super()._write_table(df, path)

    path, steps = shared_folder(spark, "run"), [(f"part {k}", step(k)) for k in range(4)]
    start = {"log": spark.createDataFrame([], "file string, step int"), "files": spark.createDataFrame([], "file string, attempts long, accepted long, reason string, seq long")}
    try:
        run(Dying(spark, path), steps, start, {"api_token": "t"})
    except Lost:
        pass
    tables = run(Snapshots(spark, path), steps, start).tables
    return tables["files"].join(tables["log"].groupBy("file").agg(F.count("*").alias("steps")), "file").drop("seq")


def _events(spark, d):
    source = spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "events*.parquet").parquet(d)
    return source.withColumn("ts", F.col("ts").cast("timestamp"))


def _drained(spark, rows):
    out = shared_folder(spark, "stream-results")
    stateful.drain(spark, rows, out, shared_folder(spark, "streams"))
    return spark.read.parquet(out).drop("batch")


#: Health figures of each event, and the recursion that the governor is, over r(key, seq, figures, overall, n): its n-th row of a key.
FIGURES = {"stability": "(event_id % 11) / 10e0", "success_rate": "(event_id % 7) / 6e0", "entropy": "(event_id % 5) / 4e0", "memory_rate": "(event_id % 3) / 2e0", "rollback_rate": "(event_id % 13) / 12e0", "trend": "(event_id % 9) / 4e0 - 1e0", "overall": "least(value / 200e0, 1e0)"}
GOVERN = """g AS (SELECT key, seq, n, overall, 0.3::DOUBLE AS accept_threshold, 0.4::DOUBLE AS exploration_rate, 100.0::DOUBLE AS max_patch_size, 15.0::DOUBLE AS max_iterations, 3.0::DOUBLE AS rollback_limit FROM r WHERE n = 1
UNION ALL SELECT r.key, r.seq, r.n, r.overall,
CASE WHEN abs(r.overall - g.overall) > 0.05::DOUBLE THEN g.accept_threshold + 0.3::DOUBLE * (least(0.7, greatest(0.1, 0.3::DOUBLE + (1 - r.stability) * 0.2::DOUBLE + (1 - r.success_rate) * 0.15::DOUBLE)) - g.accept_threshold) ELSE g.accept_threshold END,
CASE WHEN abs(r.overall - g.overall) > 0.05::DOUBLE THEN g.exploration_rate + 0.3::DOUBLE * (least(0.8, greatest(0.2, 0.4::DOUBLE + r.entropy * 0.3::DOUBLE + (1 - r.memory_rate) * 0.2::DOUBLE)) - g.exploration_rate) ELSE g.exploration_rate END,
CASE WHEN abs(r.overall - g.overall) > 0.05::DOUBLE THEN g.max_patch_size + 0.3::DOUBLE * (least(200, greatest(20, 100 * (1 - (r.rollback_rate * 0.8::DOUBLE + (1 - r.stability) * 0.5::DOUBLE) * 0.7::DOUBLE))) - g.max_patch_size) ELSE g.max_patch_size END,
CASE WHEN abs(r.overall - g.overall) > 0.05::DOUBLE THEN round_even(g.max_iterations + 0.3::DOUBLE * (least(30, greatest(5, 15 + r.trend * 5)) - g.max_iterations), 0) ELSE g.max_iterations END,
CASE WHEN abs(r.overall - g.overall) > 0.05::DOUBLE THEN round_even(g.rollback_limit + 0.3::DOUBLE * (least(5, greatest(1, 3 - (1 - r.stability) * 2)) - g.rollback_limit), 0) ELSE g.rollback_limit END
FROM g JOIN r ON r.key = g.key AND r.n = g.n + 1)"""
#: To a millionth, upwards from 0.6281: parameters are short decimals, often half-way between two of these.
TO_MILLIONTHS = "floor({0} * 1e6 + 0.3719e0) / 1e6"
ROUNDED = ", ".join(f"{TO_MILLIONTHS.format(n)} AS {n}" for n in GOVERNED)


@query("t4_governor", f"WITH RECURSIVE r AS (SELECT concat('u', user_id) AS key, event_id AS seq, {', '.join(f'({e})::DOUBLE AS {n}' for n, e in FIGURES.items())}, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events), {GOVERN} SELECT key, seq, {ROUNDED} FROM g")
def t4_governor(spark, d):
    rows = _events(spark, d).selectExpr("concat('u', user_id) AS key", "event_id AS seq", *[f"CAST({e} AS DOUBLE) AS {n}" for n, e in FIGURES.items()])
    out = _drained(spark, stateful.govern(rows))
    return out.selectExpr("key", "seq", *[f"{TO_MILLIONTHS.format(n)} AS {n}" for n in GOVERNED])


#: Each user's events as cycles of a run: findings go up and down around 60, events of a type are acceptances or rejections.
RUN = {"key": "concat('u', user_id)", "seq": "event_id", "initial": "CAST(60 AS BIGINT)", "errors": "CAST(50 + event_id % 21 AS BIGINT)", "accepted": "CAST(CASE WHEN event_type IN ('purchase', 'view') THEN 1 ELSE 0 END AS BIGINT)", "rejected": "CAST(CASE WHEN event_type = 'error' THEN 2 ELSE 0 END AS BIGINT)"}
BUDGET = 5 * 86400


@query("t4_cycles", f"""WITH RECURSIVE e AS (SELECT {', '.join(f'{x} AS {n}' for n, x in RUN.items())}, epoch_us(ts) AS us FROM events),
x AS (SELECT *, row_number() OVER w AS n, us - first_value(us) OVER w AS took, coalesce(lag(errors) OVER w, initial) - errors AS fell FROM e WINDOW w AS (PARTITION BY key ORDER BY seq)),
y AS (SELECT *, lag(fell) OVER w AS fell1, lag(accepted) OVER w AS accepted1, lag(rejected) OVER w AS rejected1 FROM x WINDOW w AS (PARTITION BY key ORDER BY seq)),
z AS (SELECT *, CASE WHEN errors = 0 THEN 'completed' WHEN initial > 0 AND errors > initial * 1.2::DOUBLE THEN 'global_invariant' END AS early, n < 30 AND took < 0.8 * {BUDGET}000000 AND (accepted > 0 OR fell > 0) AS goes_on,
CASE WHEN n < 2 THEN NULL WHEN fell < 0 AND fell1 < 0 AND errors > initial THEN 'error_growth' WHEN accepted > 0 OR accepted1 > 0 THEN NULL WHEN fell = 0 AND fell1 = 0 THEN 'plateau' WHEN fell <= 0 AND fell1 <= 0 THEN 'no_progress' WHEN rejected + rejected1 >= 4 THEN 'reject_spike' END AS later FROM y),
c AS (SELECT key, seq, n AS cycle, 4::BIGINT AS cap, CASE WHEN early IS NOT NULL THEN early END AS stop_reason FROM z WHERE n = 1
UNION ALL SELECT z.key, z.seq, CASE WHEN z.took >= {BUDGET}000000 THEN c.cycle ELSE z.n END, CASE WHEN z.took < {BUDGET}000000 AND z.early IS NULL AND z.n >= c.cap AND z.goes_on THEN least(c.cap + 2, 30) ELSE c.cap END,
CASE WHEN z.took >= {BUDGET}000000 THEN 'runtime_budget' WHEN z.early IS NOT NULL THEN z.early WHEN z.n >= c.cap THEN CASE WHEN z.goes_on THEN NULL ELSE 'max_cycles' END ELSE z.later END
FROM c JOIN z ON z.key = c.key AND z.n = c.cycle + 1 WHERE c.stop_reason IS NULL)
SELECT key, max(cycle) AS cycles, max(cap) AS cap, max(stop_reason) AS stop_reason FROM c GROUP BY key""")
def t4_cycles(spark, d):
    rows = _events(spark, d).selectExpr("ts", *[f"{x} AS {n}" for n, x in RUN.items()])
    out = _drained(spark, stateful.control_cycles(rows, float(BUDGET)))
    return out.groupBy("key").agg(F.max("cycle").cast("long").alias("cycles"), F.max("cap").cast("long").alias("cap"), F.max("stop_reason").alias("stop_reason"))


@query("t5_cache", """WITH RECURSIVE e AS (SELECT concat(event_type, user_id % 40) AS key, event_id AS seq, epoch_us(ts) AS us, row_number() OVER (PARTITION BY event_type, user_id % 40 ORDER BY event_id) AS n FROM events),
c AS (SELECT key, seq, n, us AS saved, 'miss' AS outcome FROM e WHERE n = 1 UNION ALL SELECT e.key, e.seq, e.n, CASE WHEN e.us < c.saved + 172800000000 THEN c.saved ELSE e.us END, CASE WHEN e.us < c.saved + 172800000000 THEN 'hit' ELSE 'miss' END FROM c JOIN e ON e.key = c.key AND e.n = c.n + 1),
l AS (SELECT key, max(saved) AS saved, max(n) AS n FROM c GROUP BY key)
SELECT key, seq, outcome FROM c UNION ALL SELECT l.key, c.seq, 'expired' FROM l JOIN c ON c.key = l.key AND c.n = l.n WHERE l.saved + 172800000000 <= (SELECT max(us) FROM e)""")
def t5_cache(spark, d):
    """Entries that are good for two days; what has ended when the stream ends is given as expired."""
    rows = _events(spark, d).selectExpr("concat(event_type, user_id % 40) AS key", "event_id AS seq", "ts")
    return _drained(spark, stateful.cached(rows, 172800.0)).select("key", "seq", "outcome")


@query("g8_memo", with_views("decisions", body="SELECT project, count(*) AS rows, count(DISTINCT concat(code, '|', reason)) AS contents, 0::BIGINT AS computed_again, sum(length(concat(code, '|', reason)))::BIGINT AS total FROM decisions GROUP BY project"))
def g8_memo(spark, d):
    """Results by contents: a first run computes each content once, a second one over all rows computes none."""
    memo = Memo(spark, shared_folder(spark, "memo"), "size bigint, run int")
    rows = decisions(spark, d).select("project", "code", "reason")
    compute = lambda n: lambda missing: missing.select("key", F.length(F.concat("code", F.lit("|"), "reason")).cast("long").alias("size"), F.lit(n).alias("run"))
    memo.through(rows.filter("project < 'p2'"), ["code", "reason"], compute(1))
    memo.through(rows, ["code", "reason"], compute(2))
    out = memo.through(rows, ["code", "reason"], compute(3))
    return out.groupBy("project").agg(F.count("*").alias("rows"), F.count_distinct("key").alias("contents"), F.count_if(F.col("run") == 3).alias("computed_again"), F.sum("size").alias("total"))
