"""Queries of run statistics, integrity, graphs and mining."""

from pyspark.sql import functions as F

from tallyloom.operators import graph, mining, stats
from tallyloom.plans.adapters import SQL, decisions, edges, findings, table, with_views
from tallyloom.plans.registry import query


@query("a1_error_stats", with_views("findings", body="""+x AS (SELECT coalesce(nullif(error_type, ''), 'unknown') AS t, coalesce(nullif(severity, ''), 'unknown') AS s, file, base_weight AS w FROM findings)
SELECT 'type' AS kind, t AS value, count(*) AS n, coalesce(sum(w), 0) AS total, coalesce(round(avg(w), 6), 0) AS mean, coalesce(min(w), 0) AS least, coalesce(max(w), 0) AS most FROM x GROUP BY t UNION ALL SELECT 'severity', s, count(*), coalesce(sum(w), 0), coalesce(round(avg(w), 6), 0), coalesce(min(w), 0), coalesce(max(w), 0) FROM x GROUP BY s UNION ALL SELECT 'file', file, count(*), coalesce(sum(w), 0), coalesce(round(avg(w), 6), 0), coalesce(min(w), 0), coalesce(max(w), 0) FROM x GROUP BY file UNION ALL SELECT 'all', '', count(*), coalesce(sum(w), 0), coalesce(round(avg(w), 6), 0), coalesce(min(w), 0), coalesce(max(w), 0) FROM x"""))
def a1(spark, d):
    return stats.error_stats(findings(spark, d), "base_weight").withColumn("mean", F.round("mean", 6))


@query("a3_initial_errors", with_views("findings", body="SELECT coalesce(nullif(error_class, ''), nullif(error_type, ''), 'UNKNOWN') AS class, count(*) AS n FROM findings GROUP BY 1"))
def a3(spark, d):
    return stats.counts(findings(spark, d), stats.filled("error_class", "error_type", default="UNKNOWN"), "class")


@query("a4_run_summary", with_views("decisions", body="SELECT project, count(*) AS decisions, count(*) FILTER (WHERE decision = 'ACCEPT') AS accepted, count(*) FILTER (WHERE decision = 'REJECT') AS rejected, count(*) FILTER (WHERE decision = 'NEEDS_REVIEW') AS needs_review, count(*) FILTER (WHERE symbol_regression) AS symbol_regressions, count(confidence) AS with_confidence, round(avg(confidence), 9) AS mean_confidence, round(count(*) FILTER (WHERE decision = 'ACCEPT') / nullif(count(*) FILTER (WHERE decision IN ('ACCEPT', 'REJECT', 'NEEDS_REVIEW')), 0), 9) AS accept_share FROM decisions GROUP BY project"))
def a4(spark, d):
    return stats.run_summary(decisions(spark, d), ["project"]).withColumns({c: F.round(c, 9) for c in ("mean_confidence", "accept_share")})


@query("a4_by_source", with_views("decisions", body="SELECT patch_source, decision, count(*) AS n FROM decisions WHERE patch_source <> '' GROUP BY 1, 2"))
def a4s(spark, d):
    return decisions(spark, d).filter("patch_source <> ''").groupBy("patch_source", "decision").agg(F.count("*").alias("n"))


RUN = "r AS (SELECT project, max(error_count) AS initial_errors, min(error_count) AS final_errors, CASE WHEN count(*) % 3 <> 0 THEN max(line) END AS scan_before, min(line) AS scan_after, count(DISTINCT user_id) AS iterations, count(*) FILTER (WHERE reason = 'guard') AS rollbacks, sum(floor(value * 4)::BIGINT) / 4.0 AS duration_seconds, CASE WHEN count(*) % 2 = 0 THEN 'completed' ELSE 'stalled' END AS stop_reason FROM decisions GROUP BY project)"
TALLY = "(SELECT string_agg(concat({0}, '=', n), ',' ORDER BY {0}) FROM (SELECT {0}, count(*) AS n FROM decisions x WHERE x.project = r.project AND {1} GROUP BY 1))"


@query("a4_run_kpis", with_views("decisions", body=f"""+{RUN}, f AS (SELECT project, count(DISTINCT file) FILTER (WHERE decision = 'ACCEPT') AS accepted_files, count(DISTINCT file) FILTER (WHERE decision = 'REJECT') AS rejected_files, count(*) FILTER (WHERE decision = 'NEEDS_REVIEW') AS needs_review, count(*) AS decisions, count(*) FILTER (WHERE symbol_regression) AS symbol_regressions,
 count(*) FILTER (WHERE patch_source = 'syntax_reconstruction') AS reconstruction_attempts, count(*) FILTER (WHERE patch_source = 'syntax_reconstruction' AND decision = 'FAILED') AS reconstruction_failed FROM decisions GROUP BY project)
SELECT r.project, initial_errors, final_errors, initial_errors - final_errors AS fixed, CASE WHEN initial_errors = 0 THEN 0 ELSE round(100 * (initial_errors - final_errors)::DOUBLE / initial_errors, 1) END::DOUBLE AS fixed_percent, scan_before, scan_after, scan_before - scan_after AS scan_delta, decisions, symbol_regressions, accepted_files, rejected_files, needs_review, iterations, rollbacks, round(duration_seconds, 1) AS duration_seconds, stop_reason, reconstruction_attempts, reconstruction_failed,
 coalesce({TALLY.format('decision', 'true')}, '') AS by_outcome, coalesce({TALLY.format('patch_source', "patch_source <> ''")}, '') AS by_source, coalesce({TALLY.format('review_verdict', "review_verdict <> ''")}, '') AS by_verdict, coalesce({TALLY.format('decision', "patch_source = 'syntax_reconstruction'")}, '') AS reconstruction_outcomes FROM r JOIN f ON f.project = r.project"""))
def a4k(spark, d):
    x = decisions(spark, d)
    n = F.count("*")
    runs = x.groupBy("project").agg(F.max("error_count").alias("initial_errors"), F.min("error_count").alias("final_errors"), F.when(n % 3 != 0, F.max("line")).alias("scan_before"), F.min("line").alias("scan_after"), F.count_distinct("user_id").alias("iterations"), F.count_if(F.col("reason") == "guard").alias("rollbacks"), (F.sum(F.floor(F.col("value") * 4)) / 4.0).alias("duration_seconds"), F.when(n % 2 == 0, "completed").otherwise("stalled").alias("stop_reason"))
    return stats.run_kpis(runs, x, ["project"])


@query("a5_breakdown", with_views("findings", body="SELECT tool, count(*) AS n FROM findings GROUP BY tool"))
def a5(spark, d):
    return findings(spark, d).groupBy("tool").agg(F.count("*").alias("n"))


@query("a6_total_weight", with_views("findings", body="SELECT round(sum(coalesce(base_weight, 1.0)), 6) AS total FROM findings"))
def a6(spark, d):
    return findings(spark, d).agg(F.round(F.sum(F.coalesce("base_weight", F.lit(1.0))), 6).alias("total"))


@query("a9_cascade_clusters", with_views("findings", "edges", body="+m AS (SELECT concat('c', seq % 25) AS node, count(*) AS n FROM findings GROUP BY 1 HAVING count(*) > 1) SELECT m.node, m.n, count(DISTINCT e.src) AS dependents FROM m LEFT JOIN edges e ON e.dst = m.node GROUP BY m.node, m.n"))
def a9(spark, d):
    m = findings(spark, d).groupBy(F.concat(F.lit("c"), F.col("seq") % 25).alias("node")).agg(F.count("*").alias("n")).filter("n > 1")
    deps = edges(spark, d).groupBy(F.col("dst").alias("node")).agg(F.count_distinct("src").alias("dependents"))
    return m.join(deps, "node", "left").na.fill(0, ["dependents"])


@query("a13_progress", with_views("decisions", body="SELECT project, sum(CASE WHEN decision = 'ACCEPT' THEN error_count END) AS fixed, sum(CASE WHEN decision = 'FAILED' AND seq % 1000 = 0 THEN error_count END) AS unknown FROM decisions GROUP BY project"))
def a13(spark, d):
    return decisions(spark, d).groupBy("project").agg(F.sum(F.when(F.col("decision") == "ACCEPT", F.col("error_count"))).alias("fixed"), F.sum(F.when((F.col("decision") == "FAILED") & (F.col("seq") % 1000 == 0), F.col("error_count"))).alias("unknown"))


LOG = "l AS (SELECT project, seq, CASE WHEN decision IN ('RETRY', 'FAILED') THEN 'patch' WHEN decision = 'REJECT' THEN 'reject' ELSE 'verdict' END AS kind, code, patch_source AS source, decision AS value FROM decisions)"


@query("a14_log_statistics", with_views("decisions", body=f"""+{LOG}, p AS (SELECT *, sum((kind = 'patch')::INT) OVER (PARTITION BY project ORDER BY seq ROWS UNBOUNDED PRECEDING) AS g FROM l),
q AS (SELECT *, first_value(code) OVER w AS pc, sum((kind <> 'patch')::INT) OVER (PARTITION BY project, g ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ended FROM p WINDOW w AS (PARTITION BY project, g ORDER BY seq))
SELECT CASE WHEN g > 0 AND coalesce(ended, 0) = 0 THEN pc END AS code, value, count(*) AS n FROM q WHERE kind <> 'patch' GROUP BY 1, 2"""))
def a14(spark, d):
    kind = F.when(F.col("decision").isin("RETRY", "FAILED"), "patch").when(F.col("decision") == "REJECT", "reject").otherwise("verdict")
    lines = decisions(spark, d).select("project", "seq", kind.alias("kind"), "code", F.col("patch_source").alias("source"), F.col("decision").alias("value"))
    return stats.carried_verdicts(lines, ["project"], ["seq"]).groupBy("code", "value").agg(F.count("*").alias("n"))


@query("a15_series", with_views("decisions", body="+g AS (SELECT project, count(*) FILTER (WHERE decision = 'ACCEPT') AS a, count(*) FILTER (WHERE decision = 'FAILED') AS f FROM decisions GROUP BY project), o AS (SELECT CASE WHEN f > 40 THEN 'FAIL' WHEN a > 45 THEN 'PASS' ELSE 'PARTIAL' END AS outcome FROM g) SELECT count(*) AS projects, count(*) FILTER (WHERE outcome = 'PASS') AS passed, round(count(*) FILTER (WHERE outcome = 'PASS') / nullif(count(*), 0), 3) AS rate FROM o"))
def a15(spark, d):
    g = decisions(spark, d).groupBy("project").agg(F.count_if(F.col("decision") == "ACCEPT").alias("a"), F.count_if(F.col("decision") == "FAILED").alias("f"))
    o = F.when(F.col("f") > 40, "FAIL").when(F.col("a") > 45, "PASS").otherwise("PARTIAL")
    return g.agg(F.count("*").alias("projects"), F.count_if(o == "PASS").alias("passed"), F.round(F.count_if(o == "PASS") / F.nullif(F.count("*"), F.lit(0)), 3).alias("rate"))


@query("a18_patch_cap", with_views("decisions", body="SELECT file, count(*) AS n FROM decisions WHERE decision IN ('ACCEPT', 'RETRY', 'FAILED') GROUP BY file HAVING count(*) >= 30"))
def a18(spark, d):
    return stats.patch_cap(decisions(spark, d), F.col("decision").isin("ACCEPT", "RETRY", "FAILED"))


@query("a21_history_rate", with_views("decisions", body="SELECT file, round(coalesce(least(avg(CASE WHEN decision = 'ACCEPT' THEN value / 200 END), 1.0), 0.5), 9) AS rate FROM decisions GROUP BY file"))
def a21(spark, d):
    return stats.success_rate(decisions(spark, d), ["file"], F.col("value") / 200, F.col("decision") == "ACCEPT").withColumn("rate", F.round("rate", 9))


@query("a22_parallel_merge", with_views("decisions", body="SELECT concat(file, code) AS k, max(n) AS n FROM (SELECT file, code, seq % 4 AS worker, count(*) AS n FROM decisions GROUP BY 1, 2, 3) GROUP BY 1"))
def a22(spark, d):
    per = decisions(spark, d).groupBy("file", "code", (F.col("seq") % 4).alias("worker")).agg(F.count("*").alias("n"))
    return stats.merge_counters(per.withColumn("k", F.concat("file", "code")), ["k"], "n")


@query("a22_merge_lists", with_views("decisions", body="SELECT project, seq, row_number() OVER (PARTITION BY project ORDER BY (seq % 5 <> 0)::INT, worker, seq) AS place FROM (SELECT project, seq, 0 AS worker FROM decisions WHERE seq % 5 = 0 UNION ALL SELECT project, seq, seq % 4 FROM decisions WHERE seq % 5 <> 0)"))
def a22l(spark, d):
    x = decisions(spark, d).select("project", "seq")
    base = x.filter("seq % 5 = 0").withColumn("worker", F.lit(0).cast("long"))
    parts = x.withColumn("worker", F.col("seq") % 4)  # each worker holds the base and what it has added
    return stats.merge_lists(base, parts, ["project", "seq"], ["worker", "seq"]).select("project", "seq", "place")


@query("j15_integrity", with_views("decisions", body="SELECT count(*) FILTER (WHERE decision = 'REJECT') AS log, count(*) FILTER (WHERE decision = 'REJECT' AND reason <> 'guard') AS counter, count(*) FILTER (WHERE decision = 'REJECT') - count(*) FILTER (WHERE decision = 'REJECT' AND reason <> 'guard') = count(*) FILTER (WHERE decision = 'REJECT' AND reason = 'guard') AS explained FROM decisions"))
def j15(spark, d):
    return stats.decision_integrity(decisions(spark, d), F.col("decision") == "REJECT", F.col("reason") != "guard")


@query("p36_live_decision", with_views("decisions", body="""SELECT seq, CASE WHEN error_count < line AND seq % 5 <> 0 THEN CASE WHEN review_verdict = 'wrong' OR symbol_regression THEN 'NEEDS_REVIEW' ELSE 'ACCEPT' END WHEN error_count = line AND seq % 5 <> 0 AND review_verdict IN ('ok', 'skipped') AND confidence >= 0.85 THEN 'ACCEPT' WHEN error_count >= line THEN 'REJECT:error_count_not_decreased' ELSE 'REJECT:target_error_still_present' END AS outcome FROM decisions"""))
def p36(spark, d):
    c = F.col
    fell, gone = c("error_count") < c("line"), c("seq") % 5 != 0
    sure = c("review_verdict").isin("ok", "skipped") & F.coalesce(c("confidence") >= 0.85, F.lit(False))
    outcome = F.when(fell & gone & ((c("review_verdict") == "wrong") | c("symbol_regression")), "NEEDS_REVIEW").when(fell & gone, "ACCEPT").when((c("error_count") == c("line")) & gone & sure, "ACCEPT").when(~fell, "REJECT:error_count_not_decreased").otherwise("REJECT:target_error_still_present")
    return decisions(spark, d).select("seq", outcome.alias("outcome"))


def _learned(spark, d):
    return decisions(spark, d).withColumns({"patch": F.when(F.col("seq") % 8 != 0, F.concat(F.lit("+ fix "), "seq", F.when(F.col("seq") % 10 == 0, "  # noqa").otherwise(""))), "target_removed": F.when(F.col("seq") % 3 == 0, F.col("seq") % 2 == 0), "net_delta": F.when(F.col("seq") % 4 == 0, F.col("error_count") - 30), "rollback_used": F.col("seq") % 17 == 0, "language": F.lit("")})


LEARNED = """le AS (SELECT *, CASE WHEN seq % 8 <> 0 THEN concat('+ fix ', seq, CASE WHEN seq % 10 = 0 THEN '  # noqa' ELSE '' END) END AS patch, CASE WHEN seq % 3 = 0 THEN seq % 2 = 0 END AS target_removed, CASE WHEN seq % 4 = 0 THEN error_count - 30 END AS net_delta, seq % 17 = 0 AS rollback_used FROM decisions),
ca AS (SELECT *, decision = 'ACCEPT' AND patch IS NOT NULL AND target_removed IS DISTINCT FROM false AND NOT coalesce(net_delta > 0, false) AND NOT rollback_used AND patch NOT LIKE '%# noqa%' AS clean FROM le)"""


@query("f13_clean_accept", with_views("decisions", body=f"+{LEARNED} SELECT seq FROM ca WHERE clean"))
def f13(spark, d):
    return _learned(spark, d).filter(mining.clean_accept()).select("seq")


@query("j16_preference_pairs", with_views("decisions", body=f"+{LEARNED} SELECT file, arg_min(patch, seq) FILTER (WHERE clean) AS chosen, arg_min(patch, seq) FILTER (WHERE decision = 'REJECT' AND patch IS NOT NULL) AS rejected FROM ca GROUP BY file HAVING count(*) FILTER (WHERE clean) > 0 AND count(*) FILTER (WHERE decision = 'REJECT' AND patch IS NOT NULL) > 0"))
def j16(spark, d):
    return mining.preference_pairs(_learned(spark, d), ["file"]).select("file", "chosen", "rejected")


def _verified(spark, d):
    c = F.col
    lines = lambda tail: F.array(F.concat(F.lit("call_"), "code"), F.concat(F.lit("value "), tail), F.lit(""))
    return decisions(spark, d).select(
        "seq", "code", F.lit("").alias("language"), F.when(c("seq") % 4 == 0, "STILL_FLAGGED").otherwise("REAL_FIX").alias("verdict"), (c("seq") % 19 == 0).alias("unsafe_accept"), F.when(c("seq") % 5 == 0, "weak").otherwise("strong").alias("strength"),
        F.when(c("seq") % 7 == 0, F.array(F.lit("cast"))).otherwise(F.array().cast("array<string>")).alias("weak_markers"), F.when(c("seq") % 23 == 0, 1).otherwise(0).alias("suspicious"), lines(F.lit("old")).alias("before_snippet"), lines(F.when(c("seq") % 6 == 1, "old").otherwise((c("seq") % 5).cast("string"))).alias("after_snippet"), F.lit("m").alias("message"),
    )


VERIFIED = "v AS (SELECT *, CASE WHEN seq % 4 = 0 THEN 'STILL_FLAGGED' ELSE 'REAL_FIX' END AS verdict, CASE WHEN seq % 6 = 1 THEN 'old' ELSE (seq % 5)::VARCHAR END AS tail FROM decisions), gt AS (SELECT * EXCLUDE (reason), CASE WHEN verdict <> 'REAL_FIX' THEN 'not_real_fix' WHEN seq % 19 = 0 THEN 'unsafe_accept' WHEN seq % 5 = 0 THEN 'not_strong' WHEN seq % 7 = 0 THEN 'weak_markers' WHEN seq % 23 = 0 THEN 'semantic_suspicious' WHEN code = '' THEN 'no_code' WHEN tail = 'old' THEN 'no_change' ELSE 'ok' END AS reason FROM v)"


@query("f11_harvest_gate", with_views("decisions", body=f"+{VERIFIED} SELECT reason, count(*) AS n FROM gt GROUP BY reason"))
def f11(spark, d):
    return _verified(spark, d).groupBy(mining.gate().alias("reason")).agg(F.count("*").alias("n"))


@query("f12_dataset_gate", with_views("decisions", body=f"+{VERIFIED} SELECT reason = 'ok' AS worthy, count(*) AS n FROM gt GROUP BY 1"))
def f12(spark, d):
    return _verified(spark, d).groupBy((mining.gate(False) == "ok").alias("worthy")).agg(F.count("*").alias("n"))


@query("a16_recipes", with_views("decisions", body=f"+{VERIFIED}, g AS (SELECT code, count(DISTINCT tail) AS wins FROM gt WHERE reason = 'ok' GROUP BY code) SELECT code, wins, concat('call_', regexp_extract(code, '^(\\w*)', 1)) AS word FROM g WHERE wins >= 2"))
def a16(spark, d):
    return mining.recipes(_verified(spark, d)).select("code", "wins", "word")


@query("a17_labels", with_views("decisions", body=f"+{VERIFIED}, {LEARNED}, r AS (SELECT CASE WHEN reason = 'ok' THEN 'verified_real_fix' WHEN seq % 19 = 0 THEN 'unsafe_symbol_loss' WHEN verdict = 'STILL_FLAGGED' AND tail <> 'old' THEN 'still_flagged_no_effect' END AS reason, 'verify' AS source FROM gt UNION ALL SELECT CASE WHEN decision = 'REJECT' THEN coalesce(nullif(reason, ''), 'reject') WHEN clean THEN 'clean_accept_inpipeline' END, 'learning' FROM ca WHERE patch IS NOT NULL) SELECT CASE WHEN reason IN ('verified_real_fix', 'clean_accept_inpipeline') THEN 'positive' ELSE 'negative' END AS label, reason, source, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY 1, 2, 3"))
def a17(spark, d):
    return mining.labels(_verified(spark, d), _learned(spark, d)).groupBy("label", "reason", "source").agg(F.count("*").alias("n"))


@query("j17_renames", "WITH x AS (SELECT p_brand, list(DISTINCT p_name) FILTER (WHERE p_partkey % 2 = 0) AS rem, list(DISTINCT concat(p_name, CASE p_partkey % 3 WHEN 0 THEN 's' WHEN 1 THEN '' ELSE 'xyz' END)) FILTER (WHERE p_partkey % 2 = 1) AS ad FROM part GROUP BY p_brand), o AS (SELECT p_brand, unnest(rem) AS old, rem, ad FROM x), q AS (SELECT p_brand, old, unnest(ad) AS new, rem, ad FROM o WHERE NOT list_contains(coalesce(ad, []), old)) SELECT p_brand, old, new FROM q WHERE NOT list_contains(rem, new) AND (lower(old) = lower(new) OR (abs(length(old) - length(new)) <= 2 AND levenshtein(lower(old), lower(new)) <= 2 AND least(length(old), length(new)) >= 4))")
def j17(spark, d):
    p = table(spark, d, "part")
    tail = F.when(F.col("p_partkey") % 3 == 0, "s").when(F.col("p_partkey") % 3 == 1, "").otherwise("xyz")
    x = p.groupBy("p_brand").agg(F.collect_set(F.when(F.col("p_partkey") % 2 == 0, F.col("p_name"))).alias("rem"), F.collect_set(F.when(F.col("p_partkey") % 2 == 1, F.concat("p_name", tail))).alias("ad"))
    return mining.renames(x, ["p_brand"], "rem", "ad").select("p_brand", "old", "new")


@query("g2_dependents", with_views("edges", body="SELECT dst AS node, count(*) AS n, string_agg(src, ',' ORDER BY src) AS dependents FROM edges GROUP BY dst"))
def g2(spark, d):
    return graph.dependents(edges(spark, d))


def _closure(body: str, more: str = "") -> str:
    """body over r(start, node): all nodes that depend on start, itself included."""
    return f"WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM ({SQL['edges']})), r(start, node) AS (SELECT DISTINCT dst, dst FROM e UNION SELECT r.start, e.src FROM r JOIN e ON e.dst = r.node){more} {body}"


def _starts(spark, d):
    return edges(spark, d).select(F.col("dst").alias("node")).distinct()


@query("g3_chain_score", _closure("SELECT start AS node, count(*) AS score FROM r GROUP BY start"))
def g3(spark, d):
    return graph.chain_score(edges(spark, d), _starts(spark, d))


@query("g4_cascade_score", _closure("SELECT w.node, coalesce(sum(v.weight), 0.0) AS cascade FROM w LEFT JOIN r ON r.start = w.node AND r.node <> w.node LEFT JOIN w v ON v.node = r.node GROUP BY w.node", ", w AS (SELECT DISTINCT dst AS node, length(dst)::DOUBLE AS weight FROM e)"))
def g4(spark, d):
    w = _starts(spark, d).withColumn("weight", F.length("node").cast("double"))
    return graph.cascade_score(edges(spark, d), w)


#: Nodes as paths, some of them critical, with patches of 10 to 109 lines.
PATHS = "CASE WHEN {0} LIKE 'n%' THEN concat('config/', {0}) WHEN {0} LIKE 'r%' THEN concat(CASE {0} WHEN 'r0' THEN 'src/main.py' ELSE concat('src/', {0}, '.py') END) ELSE {0} END"


@query("g5_impact", f"""WITH RECURSIVE e0 AS ({SQL['edges']}), e AS (SELECT DISTINCT {PATHS.format('src')} AS src, {PATHS.format('dst')} AS dst FROM e0), r(start, node, depth) AS (SELECT DISTINCT dst, dst, 0 FROM e UNION SELECT r.start, e.src, r.depth + 1 FROM r JOIN e ON e.dst = r.node WHERE r.depth < 16),
m AS (SELECT start, node, min(depth) AS depth FROM r GROUP BY 1, 2), g AS (SELECT start AS node, count(*) FILTER (WHERE depth = 1) AS radius, max(depth) AS depth FROM m GROUP BY 1)
SELECT node, radius, depth, round(0.3 * ln(radius + 1) + 0.2 * depth + CASE WHEN node LIKE 'config/%' OR node = 'src/main.py' THEN CASE WHEN length(node) * 7 > 50 THEN 0.75 ELSE 0.5 END ELSE 0 END, 9) AS impact FROM g""")
def g5(spark, d):
    path = lambda c: F.expr(PATHS.format(c)).alias(c)
    e = edges(spark, d).select(path("src"), path("dst"))
    return graph.impact(e, e.select(F.col("dst").alias("node")).distinct(), F.length("node") * 7).select("node", "radius", "depth", F.round("impact", 9).alias("impact"))


@query("g5_depth", f"""WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM ({SQL['edges']})), r(start, node, depth) AS (SELECT DISTINCT dst, dst, 0 FROM e UNION SELECT r.start, e.src, r.depth + 1 FROM r JOIN e ON e.dst = r.node WHERE r.depth < 16),
m AS (SELECT start, node, min(depth) AS depth FROM r GROUP BY 1, 2), g AS (SELECT start AS node, count(*) FILTER (WHERE depth = 1) AS radius, max(depth) AS depth FROM m GROUP BY 1) SELECT *, round(0.3 * ln(radius + 1) + 0.2 * depth, 9) AS impact FROM g""")
def g5d(spark, d):
    return graph.impact(edges(spark, d), _starts(spark, d)).withColumn("impact", F.round("impact", 9)).drop("criticality")


@query("g6_unused_symbols", "SELECT CASE WHEN p_brand LIKE '%1%' THEN 'unsure' WHEN p_type IN ('ECONOMY', 'PROMO') THEN 'safe' ELSE 'suppress' END AS verdict, count(*) AS n FROM part GROUP BY 1")
def g6(spark, d):
    kind = F.when(F.col("p_type").isin("ECONOMY", "PROMO"), "import").otherwise("function")
    reasons = F.array(F.when(F.col("p_brand").contains("1"), "Public name").otherwise("plain"))
    rows = table(spark, d, "part").select("p_partkey", kind.alias("kind"), reasons.alias("reasons"))
    return rows.groupBy(graph.unused_verdict(F.col("kind"), F.col("reasons"), "safe").alias("verdict")).agg(F.count("*").alias("n"))


@query("g8_state_hash", with_views("decisions", body="SELECT project, sha256(string_agg(concat(file, ':', n), ',' ORDER BY file)) AS state FROM (SELECT project, file, count(*) AS n FROM decisions GROUP BY 1, 2) GROUP BY project"))
def g8(spark, d):
    per = decisions(spark, d).groupBy("project", "file").agg(F.count("*").alias("n"))
    return per.groupBy("project").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("file", F.lit(":"), "n"))), ","), 256).alias("state"))


@query("j11_undefined", "SELECT DISTINCT concat('n', s_nationkey) AS name FROM supplier WHERE concat('n', s_nationkey) NOT IN (SELECT concat('n', n_nationkey) FROM nation WHERE n_regionkey < 3)")
def j11(spark, d):
    used = table(spark, d, "supplier").select(F.concat(F.lit("n"), "s_nationkey").alias("name"))
    return graph.missing(used, table(spark, d, "nation").filter("n_regionkey < 3").select(F.concat(F.lit("n"), "n_nationkey").alias("name")))


@query("j12_missing_dependencies", "SELECT DISTINCT concat('n', c_nationkey) AS name, n_name AS package FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey <> 0 AND c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 3 = 0) AND c_nationkey % 4 <> 1")
def j12(spark, d):
    n = lambda t, c: table(spark, d, t).select(F.concat(F.lit("n"), c).alias("name"))
    nat = table(spark, d, "nation")
    catalogue = nat.select(F.concat(F.lit("n"), "n_nationkey").alias("name"), F.col("n_name").alias("package"))
    own = nat.filter("n_regionkey = 0").select(F.concat(F.lit("n"), "n_nationkey").alias("name"))
    listed = nat.filter("n_nationkey % 4 = 1").select(F.concat(F.lit("n"), "n_nationkey").alias("name"))
    here = table(spark, d, "supplier").filter("s_suppkey % 3 = 0").select(F.concat(F.lit("n"), "s_nationkey").alias("name"))
    return graph.missing(n("customer", "c_nationkey"), own, here, listed, catalogue=catalogue)
