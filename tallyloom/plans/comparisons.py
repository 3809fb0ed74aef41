"""Queries that compare scans, filter and join findings, dedup and rank them."""

from pyspark.sql import functions as F

from tallyloom.functions import rules, text
from tallyloom.operators import cascade, dedup, diff, ranking, stats
from tallyloom.operators.graph import written
from tallyloom.plans.adapters import decisions, findings, scans, table, with_views
from tallyloom.plans.folders import shared_folder
from tallyloom.plans.registry import query
from tallyloom.plans.scalars import CLASS, NORMAL, WEIGHT, classed

KEYS = "bk AS (SELECT DISTINCT file, line, code FROM before_scan), ak AS (SELECT DISTINCT file, line, code FROM after_scan)"


@query("s1_union_sources", with_views("findings", body="SELECT tool, CASE tool WHEN 'primary' THEN 0 WHEN 'semgrep' THEN 1 WHEN 'mypy' THEN 2 ELSE 3 END AS tool_rank, count(*) AS n, min(seq) AS first FROM findings GROUP BY 1, 2"))
def s1(spark, d):
    raw = findings(spark, d)
    parts = {t: raw.filter(F.col("tool") == t).drop("tool") for t in ("primary", "semgrep", "mypy", "ruff")}
    parts["ruff"] = parts["ruff"].drop("level")
    return dedup.union_sources(parts).groupBy("tool", "tool_rank").agg(F.count("*").alias("n"), F.min("seq").alias("first"))


@query("u2_dedup_findings", with_views("findings", body="SELECT seq, file, line, message FROM (SELECT *, row_number() OVER (PARTITION BY file, line, message ORDER BY seq) AS k FROM findings) WHERE k = 1"))
def u2(spark, d):
    return dedup.dedup_findings(findings(spark, d), ["seq"]).select("seq", "file", "line", "message")


@query("u3_dedup_variants", with_views("findings", body="SELECT 'line_col_code' AS kind, count(*) AS n FROM (SELECT DISTINCT file, line, col, code FROM findings) UNION ALL SELECT 'line_code', count(*) FROM (SELECT DISTINCT file, line, code FROM findings) UNION ALL SELECT 'file_code', count(*) FROM (SELECT DISTINCT file, code FROM findings)"))
def u3(spark, d):
    f = findings(spark, d)
    out = None
    for kind, key in (("line_col_code", ["file", "line", "col", "code"]), ("line_code", ["file", "line", "code"]), ("file_code", ["file", "code"])):
        part = dedup.first_wins(f, [F.col(k) for k in key], ["seq"]).agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
        out = part if out is None else out.union(part)
    return out


@query("u4_compare_sets", with_views("before_scan", "after_scan", body=f"+{KEYS} SELECT side, count(*) AS n FROM (SELECT CASE WHEN b.file IS NULL THEN 'new' WHEN a.file IS NULL THEN 'lost' ELSE 'common' END AS side FROM bk b FULL JOIN ak a ON b.file = a.file AND b.line = a.line AND b.code = a.code) GROUP BY side"))
def u4(spark, d):
    b, a = scans(spark, d)
    return dedup.compare_sets(b, a, ["file", "line", "code"]).groupBy("side").agg(F.count("*").alias("n"))


@query("u5_replace_files", with_views("before_scan", "after_scan", body="+fs AS (SELECT DISTINCT file FROM findings WHERE line % 7 = 0 AND seq % 3 = 0) SELECT file, count(*) AS n, sum(seq) AS s FROM (SELECT file, seq FROM before_scan WHERE file NOT IN (SELECT file FROM fs) UNION ALL SELECT file, seq FROM after_scan WHERE file IN (SELECT file FROM fs)) GROUP BY file"))
def u5(spark, d):
    b, a = scans(spark, d)
    files = findings(spark, d).filter("line % 7 = 0 AND seq % 3 = 0").select("file").distinct()
    return dedup.replace_files(b, a, files).groupBy("file").agg(F.count("*").alias("n"), F.sum("seq").alias("s"))


@query("u7_line_dedup", "SELECT doc_id, count(*) AS kept FROM (SELECT DISTINCT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents) GROUP BY doc_id")
def u7(spark, d):
    return dedup.dedup_lines(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.size(F.split("text", "\n", -1)).cast("long").alias("kept"))


@query("u8_first_touch", with_views("decisions", body="SELECT project, file, min(seq) AS first FROM decisions WHERE decision = 'ACCEPT' GROUP BY project, file"))
def u8(spark, d):
    rows = decisions(spark, d).filter("decision = 'ACCEPT'")
    return dedup.first_wins(rows, [F.col("project"), F.col("file")], ["seq"]).select("project", "file", F.col("seq").alias("first"))


@query("k4_append_new", with_views("before_scan", "after_scan", body="SELECT count(*) AS n, sum(seq) AS s FROM (SELECT *, row_number() OVER (PARTITION BY file, code, error_type ORDER BY seq) AS k FROM after_scan) a WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM before_scan b WHERE b.file = a.file AND b.code = a.code AND b.error_type IS NOT DISTINCT FROM a.error_type)"))
def k4(spark, d):
    b, a = scans(spark, d)
    return dedup.append_new(a, b, ["file", "code", "error_type"], ["seq"]).agg(F.count("*").alias("n"), F.sum("seq").alias("s"))


@query("j1_new_findings", with_views("before_scan", "after_scan", body="SELECT seq, file, line, code FROM after_scan a WHERE NOT EXISTS (SELECT 1 FROM before_scan b WHERE b.file = a.file AND b.line = a.line AND b.code = a.code)"))
def j1(spark, d):
    b, a = scans(spark, d)
    return diff.new_findings(b, a).select("seq", "file", "line", "code")


DIFF = """b AS (SELECT concat(file, '::', code) AS sig, sum(coalesce(base_weight, 1.0)) AS w, count(*) AS n FROM before_scan GROUP BY 1), a AS (SELECT concat(file, '::', code) AS sig, sum(coalesce(base_weight, 1.0)) AS w, count(*) AS n FROM after_scan GROUP BY 1),
dd AS (SELECT coalesce(b.sig, a.sig) AS sig, coalesce(b.w, 0) AS before_weight, coalesce(a.w, 0) AS after_weight, coalesce(b.n, 0) AS before_count, coalesce(a.n, 0) AS after_count, CASE WHEN a.sig IS NULL THEN 'resolved' WHEN b.sig IS NULL THEN 'new' WHEN a.w > b.w + 1e-6 THEN 'regressed' WHEN a.w < b.w - 1e-6 THEN 'improved' ELSE 'unchanged' END AS status FROM b FULL JOIN a ON b.sig = a.sig)"""


def _diff(spark, d):
    add = lambda x: x.withColumns({"sig": F.concat_ws("::", "file", "code"), "w": F.coalesce("base_weight", F.lit(1.0))})
    b, a = map(add, scans(spark, d))
    return diff.weighted_diff(b, a, "sig", "w")


@query("j2_weighted_diff", with_views("before_scan", "after_scan", body=f"+{DIFF} SELECT * FROM dd"))
def j2(spark, d):
    return _diff(spark, d)


@query("j2_diff_summary", with_views("before_scan", "after_scan", body=f"+{DIFF} SELECT count(*) FILTER (WHERE status = 'resolved') AS resolved, count(*) FILTER (WHERE status = 'new') AS new, count(*) FILTER (WHERE status = 'regressed') AS regressed, count(*) FILTER (WHERE status = 'improved') AS improved, sum(before_weight) FILTER (WHERE status = 'resolved') AS resolved_weight, sum(after_weight) FILTER (WHERE status = 'new') AS new_weight, sum(before_weight) AS total_before, sum(after_weight) AS total_after FROM dd"))
def j2s(spark, d):
    return diff.diff_summary(_diff(spark, d))


def _patches(spark, d):
    """One patch per file: what it was meant to fix and the lines that it changed."""
    f = findings(spark, d)
    return f.groupBy("file").agg(F.min(F.struct("seq", F.coalesce("error_class", F.lit("")).alias("k"), "code")).alias("o"), F.array_sort(F.collect_set(F.when(F.col("seq") % 5 == 0, F.col("line")))).alias("changed_lines")).select(F.col("file").alias("patch"), F.col("file").alias("patched_file"), F.col("o.k").alias("original_class"), F.col("o.code").alias("original_code"), (F.col("o.k") == "CRITICAL_SYNTAX").alias("masking"), "changed_lines")


GROWTH = """nf AS (SELECT * FROM after_scan a WHERE NOT EXISTS (SELECT 1 FROM before_scan b WHERE b.file = a.file AND b.line = a.line AND b.code = a.code)),
cb AS (SELECT file, code, count(*) AS k FROM before_scan GROUP BY 1, 2), ca AS (SELECT file, code, count(*) AS k FROM after_scan GROUP BY 1, 2),
pq AS (SELECT file, min({'s': seq, 'k': coalesce(error_class, ''), 'c': code}) AS o, coalesce(list(DISTINCT line) FILTER (WHERE seq % 5 = 0), []) AS ch FROM findings GROUP BY file),
pp AS (SELECT file, o.k AS oc, o.c AS ocode, ch FROM pq),
j AS (SELECT nf.file AS patch, nf.seq, nf.line, nf.code, oc, ocode, oc = 'CRITICAL_SYNTAX' AS masking, coalesce(cb.k, 0) AS kb, coalesce(ca.k, 0) AS ka, len(ch) = 0 OR len([x FOR x IN ch IF abs(x - nf.line) <= 10]) > 0 AS near
  FROM nf JOIN pp ON nf.file = pp.file LEFT JOIN cb ON cb.file = nf.file AND cb.code = nf.code LEFT JOIN ca ON ca.file = nf.file AND ca.code = nf.code),
k AS (SELECT * FROM j WHERE NOT ((ocode = 'W503' AND code = 'W504') OR (ocode = 'W504' AND code = 'W503') OR (ocode = 'E501' AND code IN ('W503', 'W504'))) AND NOT (upper(oc) IN ('CLEANUP', 'FORMATTING', 'STYLE') AND ka <= kb)),
c AS (SELECT *, CASE WHEN masking AND near THEN 'uncertain' WHEN masking THEN 'unmasked' WHEN near THEN 'regression' ELSE 'uncertain' END AS bucket FROM k)"""


def _growth(spark, d):
    b, a = scans(spark, d)
    count = lambda x, name: x.groupBy("file", "code").agg(F.count("*").alias(name))
    new = diff.new_findings(b, a).join(count(b, "count_before"), ["file", "code"], "left").join(count(a, "count_after"), ["file", "code"], "left").na.fill(0, ["count_before", "count_after"])
    return diff.classify_growth(new.select(F.col("file").alias("patch"), "seq", "file", "line", "code", "count_before", "count_after"), _patches(spark, d))


@query("j3_near_changes", with_views("before_scan", "after_scan", body=f"+{GROWTH} SELECT seq FROM j WHERE near"))
def j3(spark, d):
    b, a = scans(spark, d)
    rows = diff.new_findings(b, a).join(_patches(spark, d).withColumnRenamed("patch", "file"), "file")
    near = (F.size("changed_lines") == 0) | F.exists("changed_lines", lambda x: F.abs(x - F.col("line")) <= diff.NEAR)
    return rows.filter(near).select("seq")


@query("j4_net_delta", with_views("before_scan", "after_scan", body=f"+{GROWTH} SELECT bucket, count(*) AS n, sum(seq) AS s FROM c GROUP BY bucket"))
def j4(spark, d):
    return _growth(spark, d).groupBy("bucket").agg(F.count("*").alias("n"), F.sum("seq").alias("s"))


@query("j4_decision", with_views("before_scan", "after_scan", body=f"+{GROWTH} SELECT patch, count(*) FILTER (WHERE bucket = 'regression') AS regression, count(*) FILTER (WHERE bucket = 'unmasked') AS unmasked, count(*) FILTER (WHERE bucket = 'uncertain') AS uncertain, CASE WHEN count(*) FILTER (WHERE bucket = 'regression') > 0 THEN 'rollback' WHEN count(*) FILTER (WHERE bucket = 'uncertain') > 0 THEN 'needs_review' ELSE 'keep' END AS decision FROM c GROUP BY patch"))
def j4d(spark, d):
    return diff.growth_decision(_growth(spark, d))


@query("j5_has_fresh", with_views("before_scan", "after_scan", body="SELECT DISTINCT seq FROM before_scan b WHERE EXISTS (SELECT 1 FROM after_scan a WHERE a.file = b.file AND a.code = b.code AND abs(a.line - b.line) <= 5)"))
def j5(spark, d):
    b, a = scans(spark, d)
    return diff.has_fresh(b.select("seq", "file", "line", "code"), a).select("seq").distinct()


@query("j6_known_fix", with_views("before_scan", "after_scan", body="SELECT a.seq, b.file IS NOT NULL AS known FROM after_scan a LEFT JOIN (SELECT DISTINCT file, code FROM before_scan WHERE seq % 9 = 0) b ON a.file = b.file AND a.code = b.code"))
def j6(spark, d):
    b, a = scans(spark, d)
    return diff.known_fixes(a, b.filter("seq % 9 = 0"), ["file", "code"]).select("seq", "known")


@query("j7_target_presence", with_views("before_scan", "after_scan", body=f"+{KEYS}, t AS (SELECT DISTINCT file, line, code FROM findings) SELECT t.file, t.line, t.code, bk.file IS NOT NULL AS in_before, ak.file IS NOT NULL AS in_after FROM t LEFT JOIN bk ON bk.file = t.file AND bk.line = t.line AND bk.code = t.code LEFT JOIN ak ON ak.file = t.file AND ak.line = t.line AND ak.code = t.code"))
def j7(spark, d):
    b, a = scans(spark, d)
    return diff.presence(findings(spark, d), b, a, ["file", "line", "code"])


@query("j18_reuse_by_hash", with_views("before_scan", "after_scan", body="SELECT b.seq FROM before_scan b JOIN (SELECT DISTINCT file, md5(concat(file, seq % 2)) AS h FROM after_scan) a ON a.file = b.file AND a.h = md5(concat(b.file, b.seq % 2))"))
def j18(spark, d):
    b, a = scans(spark, d)
    h = F.md5(F.concat("file", F.col("seq") % 2))
    return diff.reusable(b.withColumn("h", h), a.withColumn("h", h), ["file", "h"]).select("seq")


@query("j19_progress", with_views("before_scan", "after_scan", body="+acc AS (SELECT DISTINCT file FROM findings WHERE seq % 101 = 0) SELECT (SELECT count(*) FROM before_scan WHERE file IN (SELECT file FROM acc)) AS before, (SELECT count(*) FROM after_scan WHERE file IN (SELECT file FROM acc)) AS after"))
def j19(spark, d):
    b, a = scans(spark, d)
    acc = findings(spark, d).filter("seq % 101 = 0").select("file").distinct()
    return stats.progress(b, a, acc)


@query("j20_segments", with_views("before_scan", "after_scan", body="""+l AS (SELECT DISTINCT file, line FROM after_scan), sg AS (SELECT DISTINCT file, line - line % 10 AS a, line - line % 10 + 9 AS b FROM before_scan),
h AS (SELECT DISTINCT sg.file, a, b FROM sg JOIN l ON l.file = sg.file AND l.line BETWEEN a AND b) SELECT file, a AS "start", b AS "end" FROM h UNION ALL SELECT DISTINCT file, 1, 0 FROM l WHERE file NOT IN (SELECT file FROM h)"""))
def j20(spark, d):
    b, a = scans(spark, d)
    lo = F.col("line") - F.col("line") % 10
    return diff.in_segments(a.select("file", "line"), b.select("file", lo.alias("start"), (lo + 9).alias("end")).distinct())


@query("a10_signature_sets", with_views("findings", body="SELECT file, count(DISTINCT concat_ws('|', code, message)) AS signatures FROM findings GROUP BY file"))
def a10(spark, d):
    return findings(spark, d).groupBy("file").agg(F.count_distinct(F.concat_ws("|", "code", "message")).alias("signatures"))


@query("a11_audit", with_views("before_scan", "after_scan", body="""+b AS (SELECT DISTINCT file, code, message FROM before_scan WHERE code NOT LIKE 'clippy%'), a AS (SELECT DISTINCT file, code, message FROM after_scan WHERE code NOT LIKE 'clippy%'),
u AS (SELECT coalesce(b.file, a.file) AS file, b.file IS NOT NULL AS ib, a.file IS NOT NULL AS ia FROM b FULL JOIN a ON a.file = b.file AND a.code = b.code AND a.message = b.message),
g AS (SELECT file, count(*) FILTER (WHERE ib) AS before, count(*) FILTER (WHERE ia) AS after, count(*) FILTER (WHERE ia AND NOT ib) AS new, count(*) FILTER (WHERE ib AND NOT ia) AS lost FROM u GROUP BY file)
SELECT *, CASE WHEN new = 0 AND lost > 0 THEN 'IMPROVED' WHEN new = 0 THEN 'NO_DEGRADATION' ELSE 'NEW_ERRORS' END AS verdict FROM g"""))
def a11(spark, d):
    keep = lambda x: x.filter(~rules.non_blocking(F.col("code"), F.col("message")))
    b, a = map(keep, scans(spark, d))
    return diff.audit(b, a, ["code", "message"])


@query("a2_compare_stats", with_views("before_scan", "after_scan", body="SELECT coalesce(b.code, a.code) AS value, coalesce(a.n, 0) - coalesce(b.n, 0) AS delta FROM (SELECT code, count(*) AS n FROM before_scan GROUP BY code) b FULL JOIN (SELECT code, count(*) AS n FROM after_scan GROUP BY code) a ON a.code = b.code"))
def a2(spark, d):
    from tallyloom.operators.stats import compare_counts

    b, a = scans(spark, d)
    return compare_counts(b, a, F.col("code"))


@query("o1_rank", with_views("findings", body="SELECT seq, CASE severity WHEN 'critical' THEN 100.0 WHEN 'error' THEN 10.0 WHEN 'warning' THEN 1.0 ELSE 0.0 END::DOUBLE AS rank_priority FROM findings"))
def o1(spark, d):
    return ranking.rank(findings(spark, d).withColumn("priority", F.lit(None).cast("double"))).select("seq", "rank_priority")


@query("o2_prioritize", with_views("before_scan", "findings", body=f"+{CLASS}, w AS (SELECT c.*, {WEIGHT.format('cls')} AS w0, (SELECT count(*) FROM (VALUES ('E501'), ('F401')) v(x) WHERE v.x = c.code) > 0 AS fix, concat(file, code) IN (SELECT concat(file, code) FROM before_scan WHERE seq % 50 = 0) AS known FROM classed c) SELECT seq, CASE WHEN code = 'E0765' THEN 9999.0 ELSE greatest(w0, CASE WHEN fix THEN 95.0 ELSE 0 END, CASE WHEN known THEN 98.0 ELSE 0 END) END::DOUBLE AS weight FROM w"))
def o2(spark, d):
    f = classed(spark, d).withColumn("signature", F.concat("file", "code"))
    known = scans(spark, d)[0].filter("seq % 50 = 0").select(F.concat("file", "code").alias("signature"))
    fixable = spark.createDataFrame([("E501",), ("F401",)], "code string")
    return ranking.prioritize(f, fixable, known, "cls").select("seq", "weight")


@query("o5_top_codes", with_views("findings", body="SELECT code, count(*) AS n FROM findings WHERE code <> '' GROUP BY code ORDER BY n DESC, min(seq) LIMIT 10"))
def o5(spark, d):
    return findings(spark, d).filter("code <> ''").groupBy("code").agg(F.count("*").alias("n"), F.min("seq").alias("f")).orderBy(F.desc("n"), "f").limit(10).drop("f")


@query("o6_top_examples", with_views("decisions", body="SELECT seq, patch_source FROM (SELECT *, row_number() OVER (PARTITION BY patch_source ORDER BY value DESC, seq) AS place FROM decisions) WHERE place <= 3 ORDER BY value DESC, seq LIMIT 5"))
def o6(spark, d):
    rows = ranking.top(decisions(spark, d), ["patch_source"], 3, [F.desc("value"), F.col("seq")])
    return rows.orderBy(F.desc("value"), "seq").limit(5).select("seq", "patch_source")


@query("o8_nearest_match", with_views("before_scan", "after_scan", body="""+an AS (SELECT seq AS id, file, line, message AS m FROM before_scan), h AS (SELECT an.id, an.line, a.line AS pos FROM an JOIN after_scan a ON a.file = an.file AND a.message = an.m),
g AS (SELECT id, arg_min(pos, abs(pos - line) * 1000 + pos) FILTER (WHERE abs(pos - line) <= 15) AS near, count(*) AS k, min(pos) AS only_ FROM h GROUP BY id) SELECT an.id, CASE WHEN near IS NOT NULL THEN near WHEN k = 1 THEN only_ END AS found FROM an LEFT JOIN g ON g.id = an.id"""))
def o8(spark, d):
    b, a = scans(spark, d)
    anchors = b.select(F.col("seq").alias("id"), "file", "line", F.col("message").alias("match"))
    return ranking.nearest_match(anchors, a.select("file", "line", F.col("message").alias("text")))


@query("o9_max_version", "SELECT p_brand, arg_max(p_partkey, (p_size % 5) * 1000000 + p_partkey) AS best FROM part WHERE p_partkey % 7 <> 0 GROUP BY p_brand")
def o9(spark, d):
    v = F.struct((F.col("p_size") % 5).alias("major"), F.col("p_partkey").alias("minor"))
    return table(spark, d, "part").filter("p_partkey % 7 <> 0").groupBy("p_brand").agg(F.max(v)["minor"].alias("best"))


@query("a7_clusters", with_views("findings", body="SELECT file, count(*) AS n, sum(CASE WHEN coalesce(base_weight, 0) = 0 THEN 1.0 ELSE base_weight END) AS total_priority, max(CASE WHEN coalesce(base_weight, 0) = 0 THEN 1.0 ELSE base_weight END) AS max_priority FROM findings GROUP BY file"))
def a7(spark, d):
    return ranking.clusters(findings(spark, d), "base_weight")


@query("a8_top_files", with_views("findings", body="SELECT file, sum(coalesce(base_weight, 1.0)) AS total FROM findings GROUP BY file ORDER BY total DESC, file LIMIT 5"))
def a8(spark, d):
    return findings(spark, d).groupBy("file").agg(F.sum(F.coalesce("base_weight", F.lit(1.0))).alias("total")).orderBy(F.desc("total"), "file").limit(5)


@query("f2_drop_banned", with_views("findings", body="+x AS (SELECT DISTINCT file, line, code FROM findings WHERE seq % 37 = 0) SELECT count(*) AS n, sum(seq) AS s FROM findings f WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.file = f.file AND x.line = f.line AND x.code = f.code)"))
def f2(spark, d):
    f = findings(spark, d)
    return ranking.drop_banned(f, f.filter("seq % 37 = 0")).agg(F.count("*").alias("n"), F.sum("seq").alias("s"))


TOXIC = "x AS (SELECT DISTINCT file FROM findings WHERE seq % 211 = 0)"


@query("f3_drop_toxic", with_views("findings", body=f"+{TOXIC} SELECT count(*) AS n, sum(seq) AS s FROM findings WHERE coalesce(error_class, '') = 'CRITICAL_SYNTAX' OR code IN ('E999', 'E902', 'invalid-syntax') OR file NOT IN (SELECT file FROM x)"))
def f3(spark, d):
    f = findings(spark, d)
    return ranking.drop_toxic(f, f.filter("seq % 211 = 0"))[0].agg(F.count("*").alias("n"), F.sum("seq").alias("s"))


@query("f3_toxic_skipped", with_views("findings", body=f"+{TOXIC} SELECT file, count(*) AS skipped FROM findings WHERE NOT (coalesce(error_class, '') = 'CRITICAL_SYNTAX' OR code IN ('E999', 'E902', 'invalid-syntax')) AND file IN (SELECT file FROM x) GROUP BY file"))
def f3s(spark, d):
    f = findings(spark, d)
    return ranking.drop_toxic(f, f.filter("seq % 211 = 0"))[1]


@query("f4_toxic_classes", with_views("findings", body="+x AS (SELECT DISTINCT file, code FROM findings WHERE seq % 101 = 0) SELECT code, count(*) AS n FROM findings f WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.file = f.file AND x.code = f.code) GROUP BY code"))
def f4(spark, d):
    f = findings(spark, d)
    return f.join(f.filter("seq % 101 = 0").select("file", "code").distinct(), ["file", "code"], "left_anti").groupBy("code").agg(F.count("*").alias("n"))


@query("f5_context", with_views("findings", body="SELECT count(*) AS n FROM findings WHERE file IN (SELECT file FROM findings WHERE seq % 53 = 0)"))
def f5(spark, d):
    f = findings(spark, d)
    return f.join(f.filter("seq % 53 = 0").select("file").distinct(), "file", "left_semi").agg(F.count("*").alias("n"))


@query("f6_candidates", with_views("findings", "decisions", body="+t AS (SELECT code, count(*) AS k FROM decisions WHERE decision = 'REJECT' GROUP BY code) SELECT f.code, count(*) AS n FROM findings f LEFT JOIN t ON t.code = f.code WHERE coalesce(t.k, 0) < 300 GROUP BY f.code"))
def f6(spark, d):
    tries = decisions(spark, d).filter("decision = 'REJECT'").groupBy("code").agg(F.count("*").alias("k"))
    return findings(spark, d).join(tries, "code", "left").filter(F.coalesce("k", F.lit(0)) < 300).groupBy("code").agg(F.count("*").alias("n"))


@query("f9_unprotected", with_views("findings", body="SELECT count(*) AS n FROM findings WHERE file NOT LIKE 'src/m1/%'"))
def f9(spark, d):
    f = findings(spark, d).withColumn("file", F.when(F.col("file").startswith("src/m1/"), F.concat(F.lit("config/"), "file")).otherwise(F.col("file")))
    return ranking.unprotected(f).agg(F.count("*").alias("n"))


@query("f16_group_noise", with_views("findings", body="SELECT seq FROM (SELECT *, sum(CASE WHEN code IN ('E302', 'W503') THEN 1 ELSE 0 END) OVER (PARTITION BY file) AS k FROM findings) WHERE k < 17"))
def f16(spark, d):
    return ranking.drop_noisy_files(findings(spark, d), ("E302", "W503"), 17).select("seq")


CRIT = "cr AS (SELECT file, arg_min(seq, line::BIGINT * 100000000 + seq) AS root, min(line) AS root_line FROM findings WHERE error_class = 'CRITICAL_SYNTAX' GROUP BY file)"


@query("w15_syntax_cascade", with_views("findings", body=f"+{CRIT} SELECT f.seq, coalesce(f.seq = cr.root, false) AS is_root, coalesce(f.seq <> cr.root AND f.line >= cr.root_line, false) AS derived FROM findings f LEFT JOIN cr ON cr.file = f.file"))
def w15(spark, d):
    return cascade.syntax_cascade(findings(spark, d)).select("seq", "is_root", F.col("derived_from").isNotNull().alias("derived"))


@query("w16_symbol_clusters", with_views("findings", body="""+s AS (SELECT *, list_concat(regexp_extract_all(message, '`([A-Za-z_][A-Za-z0-9_:.<>-]*)`', 1), regexp_extract_all(message, '''([A-Za-z_][A-Za-z0-9_:.<>-]*)''', 1))[1] AS sym FROM findings), k AS (SELECT *, count(*) OVER (PARTITION BY sym) AS n, row_number() OVER (PARTITION BY sym ORDER BY file, line, seq) AS p FROM s WHERE sym IS NOT NULL)
SELECT seq, p = 1 AS is_root, p > 1 AS derived FROM k WHERE n >= 3"""))
def w16(spark, d):
    f = findings(spark, d).withColumns({"sig": text.cascade_signature(F.col("file"), F.col("line"), F.col("code"), F.col("message")), "is_root": F.lit(False), "derived_from": F.lit(None).cast("string")})
    f = written(f.withColumn("id", F.monotonically_increasing_id()), shared_folder(spark, "clusters"))  # ids as written; seq is not unique
    out = cascade.symbol_cascade(f, row="id")
    return out.filter("is_root OR derived_from IS NOT NULL").select("seq", "is_root", F.col("derived_from").isNotNull().alias("derived"))


#: The three rules of a collapse: candidates of a file one by one, with the symbols of the roots so far; what the roots mark; symbol clusters of what is left.
COLLAPSED = f"""+b0 AS (SELECT row_number() OVER () AS id, seq, file, line, code, message, error_class, concat(file, '::', line, '::', CASE WHEN code <> '' THEN code ELSE substr(message, 1, 60) END) AS sig, list_concat(regexp_extract_all(message, '`([A-Za-z_][A-Za-z0-9_:.<>-]*)`', 1), regexp_extract_all(message, '''([A-Za-z_][A-Za-z0-9_:.<>-]*)''', 1)) AS names FROM findings),
cr AS (SELECT file, min(struct_pack(l := line, q := seq, g := sig)) AS r FROM b0 WHERE error_class = 'CRITICAL_SYNTAX' GROUP BY file),
b AS (SELECT b0.*, coalesce(b0.seq = cr.r.q, false) AS r1, coalesce(b0.seq <> cr.r.q AND b0.line >= cr.r.l, false) AS d1, cr.r.g AS by1 FROM b0 LEFT JOIN cr ON cr.file = b0.file),
c AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY line, seq, code, message) AS k FROM b WHERE NOT d1 AND len(names) > 0 AND code IN ({', '.join(f"'{x}'" for x in rules.MISSING_DEPENDENCY)})),
z AS (SELECT file, k, true AS root, names AS known FROM c WHERE k = 1 UNION ALL SELECT c.file, c.k, len(list_filter(z.known, lambda n: contains(c.message, n))) = 0, CASE WHEN len(list_filter(z.known, lambda n: contains(c.message, n))) = 0 THEN list_distinct(list_concat(z.known, c.names)) ELSE z.known END FROM z JOIN c ON c.file = z.file AND c.k = z.k + 1),
rt AS (SELECT c.* FROM c JOIN z ON z.file = c.file AND z.k = c.k WHERE z.root),
m AS (SELECT b.id, arg_min(rt.sig, rt.k) AS by2 FROM b JOIN rt ON rt.file = b.file AND rt.line <= b.line AND rt.id <> b.id AND len(list_filter(rt.names, lambda n: contains(b.message, n))) > 0 WHERE NOT b.d1 GROUP BY b.id),
e AS (SELECT b.*, b.r1 OR rt.id IS NOT NULL AS r2, CASE WHEN b.d1 THEN b.by1 ELSE m.by2 END AS by2 FROM b LEFT JOIN rt ON rt.id = b.id LEFT JOIN m ON m.id = b.id),
u AS (SELECT id, count(*) OVER w AS n, min(struct_pack(f := file, l := line, q := seq, g := sig)) OVER w AS lead FROM e WHERE by2 IS NULL AND NOT r2 AND len(names) > 0 WINDOW w AS (PARTITION BY names[1])),
x AS (SELECT e.seq, e.sig, e.r2 OR coalesce(u.n >= 3 AND u.lead.q = e.seq, false) AS is_root, CASE WHEN u.n >= 3 AND u.lead.q <> e.seq THEN u.lead.g ELSE e.by2 END AS derived_from FROM e LEFT JOIN u ON u.id = e.id) """


def _collapsed(body: str) -> str:
    return with_views("findings", body=COLLAPSED + body).replace("WITH ", "WITH RECURSIVE ", 1)


@query("j9_cascade", _collapsed("SELECT seq, is_root, derived_from, derived_from IS NOT NULL AS derived FROM x"))
def j9(spark, d):
    return cascade.collapse(findings(spark, d)).select("seq", "is_root", "derived_from", "derived")


@query("j8_cascade_groups", _collapsed("SELECT r.sig, r.root, coalesce(k.derived, 0) AS derived, k.first FROM (SELECT sig, min(seq) AS root FROM x WHERE derived_from IS NULL GROUP BY sig) r LEFT JOIN (SELECT derived_from AS sig, count(*) AS derived, min(seq) AS first FROM x WHERE derived_from IS NOT NULL GROUP BY derived_from) k ON k.sig = r.sig"))
def j8(spark, d):
    return cascade.groups(cascade.collapse(findings(spark, d)))


@query("o3_root_cause", with_views("findings", body="""+cl AS (SELECT file, sum(CASE WHEN coalesce(base_weight, 0) = 0 THEN 1.0 ELSE base_weight END) AS t, max(CASE WHEN coalesce(base_weight, 0) = 0 THEN 1.0 ELSE base_weight END) AS m FROM findings GROUP BY file), best AS (SELECT file FROM cl ORDER BY m DESC, t DESC, file DESC LIMIT 1)
SELECT seq, file FROM findings WHERE file IN (SELECT file FROM best) ORDER BY coalesce(base_weight, 0) DESC, line DESC, seq LIMIT 1"""))
def o3(spark, d):
    none = spark.createDataFrame([], "file string, cascade double")
    return ranking.root_cause(findings(spark, d), none, "base_weight").select("seq", "file")


@query("o4_cascade_order", _collapsed("SELECT derived_from IS NOT NULL AS derived, count(*) AS n, min(seq) AS first FROM x GROUP BY 1"))
def o4(spark, d):
    return cascade.collapse(findings(spark, d)).groupBy("derived").agg(F.count("*").alias("n"), F.min("seq").alias("first"))


@query("entry_risk_by_file", with_views("findings", body=f"+dd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file, line, message ORDER BY seq) AS k FROM findings) WHERE k = 1), classed AS (SELECT *, {CLASS[CLASS.index('CASE'):CLASS.rindex(' AS cls')]} AS cls FROM dd) SELECT file, count(*) AS n, sum({WEIGHT.format('cls')}) AS total, max({WEIGHT.format('cls')}) AS worst FROM classed GROUP BY file"))
def entry_query(spark, d):
    f = dedup.dedup_findings(findings(spark, d, place=True), ["seq", "place"])  # seq is not unique
    w = rules.class_weight(rules.classify(F.col("file"), F.col("code"), F.col("level"), F.col("message")))
    return f.groupBy("file").agg(F.count("*").alias("n"), F.sum(w).alias("total"), F.max(w).alias("worst"))
