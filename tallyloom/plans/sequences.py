"""Queries over ordered steps of each project: health, streaks, resets, stop rules."""

from pyspark.sql import functions as F

from tallyloom.operators import streaks
from tallyloom.plans.adapters import decisions, with_views
from tallyloom.plans.registry import query

KEY, ORDER = ["project"], ["seq"]


@query("w1_degrading", with_views("decisions", body="SELECT seq, coalesce(error_count > avg(error_count) OVER (PARTITION BY project ORDER BY seq ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), false) AS degrading FROM decisions"))
def w1(spark, d):
    return streaks.degrading(decisions(spark, d), KEY, ORDER, "error_count").select("seq", "degrading")


def _health(spark, d):
    is_ = lambda v: F.col("decision") == v
    one = lambda c: F.when(c, 1).otherwise(0)
    return streaks.health(decisions(spark, d), KEY, ORDER, count="error_count", rollback=is_("REJECT"), failed=is_("FAILED"), accepted=one(is_("ACCEPT")), rejected=one(is_("REJECT")), from_memory=F.col("patch_source") == "memory", has_patch=F.col("patch_source") != "", label="decision")


HEALTH = """x AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY seq) AS k FROM decisions), h AS (SELECT seq, count(*) OVER w AS n, sum((decision = 'REJECT')::INT) OVER w AS rb, sum((decision = 'FAILED')::INT) OVER w AS fl, sum((decision = 'ACCEPT')::INT) OVER w AS ac,
 sum((patch_source = 'memory')::INT) OVER w AS mem, sum((patch_source <> '')::INT) OVER w AS pat, regr_slope(error_count::DOUBLE, k::DOUBLE) OVER w AS slope,
 sum((decision = 'ACCEPT')::INT) OVER w AS c1, sum((decision = 'REJECT')::INT) OVER w AS c2, sum((decision = 'RETRY')::INT) OVER w AS c3, sum((decision = 'NEEDS_REVIEW')::INT) OVER w AS c4, sum((decision = 'FAILED')::INT) OVER w AS c5
 FROM x WINDOW w AS (PARTITION BY project ORDER BY seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))"""


@query("w2_health", with_views("decisions", body=f"+{HEALTH} SELECT seq, CASE WHEN n < 2 THEN 1.0 ELSE round(1.0 - (rb + fl) / n, 9) END::DOUBLE AS stability, CASE WHEN n < 2 THEN 0.0 ELSE round(rb / n, 9) END::DOUBLE AS rollback_rate, CASE WHEN n < 2 THEN 1.0 WHEN ac + rb > 0 THEN round(ac / (ac + rb), 9) ELSE 1.0 END::DOUBLE AS success_rate, CASE WHEN n < 2 OR pat = 0 THEN 0.0 ELSE round(mem / pat, 9) END::DOUBLE AS memory_rate FROM h"))
def w2(spark, d):
    return _health(spark, d).select("seq", *[F.round(c, 9).alias(c) for c in ("stability", "rollback_rate", "success_rate", "memory_rate")])


@query("w3_trend", with_views("decisions", body=f"+{HEALTH} SELECT seq, CASE WHEN n < 2 THEN 0.0 ELSE round(greatest(-1.0, least(1.0, -coalesce(slope, 0) / 5.0)), 7) + 0.0 END::DOUBLE AS trend FROM h"))
def w3(spark, d):
    return _health(spark, d).select("seq", (F.round("trend", 7) + F.lit(0.0)).alias("trend"))


@query("w5_entropy", with_views("decisions", body=f"+{HEALTH}, e AS (SELECT seq, n, list_sum([CASE WHEN c = 0 THEN 0 ELSE -(c / n) * log2(c / n) END FOR c IN [c1, c2, c3, c4, c5]]) / 2.0 AS e FROM h) SELECT seq, CASE WHEN n < 2 THEN 0.0 ELSE round(e, 7) + 0.0 END::DOUBLE AS entropy FROM e"))
def w5(spark, d):
    return _health(spark, d).select("seq", (F.round("entropy", 7) + F.lit(0.0)).alias("entropy"))


@query("p27_overall_health", with_views("decisions", body=f"+{HEALTH} SELECT seq, CASE WHEN n < 2 THEN round(0.20 + 0.15 * 1.0 + 0.10 * 0.0, 7) ELSE round(0.20 * (1.0 - (rb + fl) / n) + 0.15 * (CASE WHEN ac + rb > 0 THEN ac / (ac + rb) ELSE 1.0 END) + 0.10 * (CASE WHEN pat = 0 THEN 0.0 ELSE mem / pat END), 7) END::DOUBLE AS part FROM h"))
def p27(spark, d):
    h = _health(spark, d)
    return h.select("seq", F.round(0.20 * F.col("stability") + 0.15 * F.col("success_rate") + 0.10 * F.col("memory_rate"), 7).alias("part"))


@query("w6_inferred_decision", with_views("decisions", body="SELECT seq, CASE WHEN lag(decision) OVER w IS NULL THEN 'UNKNOWN' WHEN lag(decision) OVER w = 'RETRY' THEN CASE decision WHEN 'ACCEPT' THEN 'ACCEPT' WHEN 'RETRY' THEN 'RETRY' WHEN 'REJECT' THEN 'REJECT' WHEN 'FAILED' THEN 'ESCALATE' ELSE decision END ELSE decision END AS inferred FROM decisions WINDOW w AS (PARTITION BY project ORDER BY seq)"))
def w6(spark, d):
    w = streaks.over(KEY, ORDER)
    before = F.lag("decision").over(w)
    inferred = F.when(before.isNull(), "UNKNOWN").when((before == "RETRY") & (F.col("decision") == "FAILED"), "ESCALATE").otherwise(F.col("decision"))
    return decisions(spark, d).select("seq", inferred.alias("inferred"))


@query("w7_cycle_deltas", with_views("decisions", body="SELECT seq, error_count - coalesce(lag(error_count) OVER w, 0) AS error_count_delta, line - coalesce(lag(line) OVER w, 0) AS line_delta FROM decisions WINDOW w AS (PARTITION BY project ORDER BY seq)"))
def w7(spark, d):
    return streaks.deltas(decisions(spark, d), KEY, ORDER, ["error_count", "line"]).select("seq", "error_count_delta", "line_delta")


@query("w8_stop_reason", with_views("decisions", body="""+x AS (SELECT *, (decision = 'ACCEPT')::INT AS acc, (decision = 'REJECT')::INT * 3 AS rej, row_number() OVER w AS cycle, first_value(error_count) OVER w + 5 AS ini, lag(error_count) OVER w AS l1 FROM decisions WINDOW w AS (PARTITION BY project ORDER BY seq)),
y AS (SELECT *, coalesce(l1, ini) - error_count AS dl FROM x), z AS (SELECT *, lag(acc) OVER w AS la, lag(rej) OVER w AS lr, lag(dl) OVER w AS ld FROM y WINDOW w AS (PARTITION BY project ORDER BY seq))
SELECT seq, CASE WHEN error_count = 0 THEN 'completed' WHEN ini > 0 AND error_count > ini * 1.2::DOUBLE THEN 'global_invariant' WHEN cycle * 1.0 >= 200 THEN 'runtime_budget' WHEN cycle >= 150 THEN 'max_cycles' WHEN dl < 0 AND ld < 0 AND error_count > ini THEN 'error_growth' WHEN acc = 0 AND la = 0 AND dl = 0 AND ld = 0 THEN 'plateau' WHEN acc = 0 AND la = 0 AND dl <= 0 AND ld <= 0 THEN 'no_progress' WHEN acc = 0 AND la = 0 AND rej + lr >= 4 THEN 'reject_spike' END AS stop_reason FROM z"""))
def w8(spark, d):
    df = decisions(spark, d).withColumns({"acc": F.when(F.col("decision") == "ACCEPT", 1).otherwise(0), "rej": F.when(F.col("decision") == "REJECT", 3).otherwise(0), "ini": F.first("error_count").over(streaks.over(KEY, ORDER)) + 5})
    return streaks.stop_reason(df, KEY, ORDER, count="error_count", initial=F.col("ini"), accepted="acc", rejected="rej", elapsed=F.row_number().over(streaks.over(KEY, ORDER)) * 1.0, budget=200.0, max_cycles=150).select("seq", "stop_reason")


ISLAND = "x AS (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY seq) - row_number() OVER (PARTITION BY {k}, {v} ORDER BY seq) AS g FROM decisions)"


@query("w9_failure_streak", with_views("decisions", body=f"+{ISLAND.format(k='file', v='reason')} SELECT seq, row_number() OVER (PARTITION BY file, reason, g ORDER BY seq) AS streak FROM x"))
def w9(spark, d):
    return streaks.streak(decisions(spark, d), ["file"], ORDER, F.col("reason")).select("seq", "streak")


@query("w10_occurrence", with_views("decisions", body="+x AS (SELECT *, sum((decision = 'ACCEPT')::INT) OVER (PARTITION BY file, code ORDER BY seq ROWS UNBOUNDED PRECEDING) AS g FROM decisions) SELECT seq, sum((decision <> 'ACCEPT')::INT) OVER (PARTITION BY file, code, g ORDER BY seq ROWS UNBOUNDED PRECEDING)::BIGINT AS occurrence FROM x"))
def w10(spark, d):
    ok = F.col("decision") == "ACCEPT"
    return streaks.count_since(decisions(spark, d), ["file", "code"], ORDER, ~ok, ok, "occurrence").select("seq", "occurrence")


@query("w11_file_attempts", with_views("decisions", body="+x AS (SELECT *, sum((symbol_regression)::INT) OVER (PARTITION BY file ORDER BY seq ROWS UNBOUNDED PRECEDING) AS g FROM decisions) SELECT seq, row_number() OVER (PARTITION BY file, g ORDER BY seq) AS attempts FROM x"))
def w11(spark, d):
    df = decisions(spark, d).withColumn("g", F.sum(F.when(F.col("symbol_regression"), 1).otherwise(0)).over(streaks.over(["file"], ORDER)))
    return df.select("seq", F.row_number().over(streaks.over(["file", "g"], ORDER)).alias("attempts"))


@query("w12_fail_streak", with_views("decisions", body="+y AS (SELECT *, decision = 'FAILED' AS f FROM decisions), x AS (SELECT *, sum((NOT f)::INT) OVER (PARTITION BY project ORDER BY seq ROWS UNBOUNDED PRECEDING) AS g FROM y) SELECT seq, sum(f::INT) OVER (PARTITION BY project, g ORDER BY seq ROWS UNBOUNDED PRECEDING)::BIGINT AS fails FROM x"))
def w12(spark, d):
    bad = F.col("decision") == "FAILED"
    return streaks.count_since(decisions(spark, d), KEY, ORDER, bad, ~bad, "fails").select("seq", "fails")


@query("w13_no_effect", with_views("decisions", body="SELECT seq, sum((decision = 'REJECT' AND reason = 'no_effect')::INT) OVER (PARTITION BY file, code ORDER BY seq ROWS UNBOUNDED PRECEDING)::BIGINT AS k FROM decisions"))
def w13(spark, d):
    hit = (F.col("decision") == "REJECT") & (F.col("reason") == "no_effect")
    return decisions(spark, d).select("seq", F.sum(F.when(hit, 1).otherwise(0)).over(streaks.over(["file", "code"], ORDER)).alias("k"))


@query("w14_returns", with_views("decisions", body="SELECT seq, row_number() OVER (PARTITION BY file, code ORDER BY seq) AS occurrence, row_number() OVER (PARTITION BY file, code ORDER BY seq) > 2 AS banned FROM decisions"))
def w14(spark, d):
    return streaks.nth_return(decisions(spark, d), ["file", "code"], ORDER).select("seq", "occurrence", "banned")


@query("w17_quarantine", with_views("decisions", body="""+b AS (SELECT DISTINCT file FROM decisions WHERE decision = 'REJECT'), a AS (SELECT 'src' AS folder, file FROM b UNION ALL SELECT regexp_extract(file, '^(src/[^/]+)/', 1), file FROM b), g AS (SELECT folder, count(*) AS files FROM a GROUP BY folder) SELECT * FROM g WHERE files >= CASE WHEN folder = 'src' THEN 6 ELSE 3 END"""))
def w17(spark, d):
    return streaks.quarantined(decisions(spark, d).filter("decision = 'REJECT'"))


@query("w18_target_cap", with_views("decisions", body="+x AS (SELECT *, sum((decision = 'REJECT' AND reason = 'target_error_still_present')::INT) OVER (PARTITION BY file ORDER BY seq ROWS UNBOUNDED PRECEDING) AS k FROM decisions) SELECT seq FROM x WHERE k >= 3"))
def w18(spark, d):
    hit = (F.col("decision") == "REJECT") & (F.col("reason") == "target_error_still_present")
    return decisions(spark, d).withColumn("k", F.sum(F.when(hit, 1).otherwise(0)).over(streaks.over(["file"], ORDER))).filter("k >= 3").select("seq")
