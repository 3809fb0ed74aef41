"""Queries of decisions and steering, parser-based scanners, further sources and sinks."""

from pyspark.sql import functions as F

from tallyloom.operators import code, control, graph, mining
from tallyloom.plans.adapters import decisions, edges, findings, scans, table, with_views
from tallyloom.plans.folders import shared_folder
from tallyloom.plans.registry import query
from tallyloom.plans.sequences import HEALTH, _health
from tallyloom.plans.state import GOVERN, ROUNDED, TO_MILLIONTHS
from tallyloom.plans.texts import _lines_sql, _snippet_sql, _source_texts, snippets, source_lines
from tallyloom.sources import sinks, tools


@query("a12_verdict_from_sets", with_views("before_scan", "after_scan", body="+n AS (SELECT count(*) AS new FROM (SELECT code, message FROM after_scan EXCEPT SELECT code, message FROM before_scan)), l AS (SELECT count(*) AS lost FROM (SELECT code, message FROM before_scan EXCEPT SELECT code, message FROM after_scan)) SELECT new, lost, CASE WHEN new = 0 AND lost > 0 THEN 'IMPROVED' WHEN new = 0 THEN 'NO_DEGRADATION' ELSE 'NEW_ERRORS' END AS verdict FROM n, l"))
def a12(spark, d):
    from tallyloom.operators.dedup import compare_sets

    b, a = scans(spark, d)
    c = compare_sets(b, a, ["code", "message"]).agg(F.count_if(F.col("side") == "new").alias("new"), F.count_if(F.col("side") == "lost").alias("lost"))
    return c.withColumn("verdict", F.when((F.col("new") == 0) & (F.col("lost") > 0), "IMPROVED").when(F.col("new") == 0, "NO_DEGRADATION").otherwise("NEW_ERRORS"))


@query("p23_quality_evaluation", with_views("decisions", body="""+x AS (SELECT seq, seq % 3 = 0 AS was, seq % 6 = 0 AS still, CASE WHEN seq % 7 = 0 THEN 'ESCALATE' END AS act, value / 250 - 1 AS score, CASE seq % 4 WHEN 0 THEN 'security' WHEN 1 THEN 'lint' WHEN 2 THEN 'syntax' ELSE 'other' END AS t FROM decisions), y AS (SELECT *, CASE t WHEN 'security' THEN 0.8 WHEN 'lint' THEN 0.3 WHEN 'syntax' THEN 0.6 ELSE 0.5 END AS lim FROM x)
SELECT seq, CASE WHEN was AND NOT still THEN 'ACCEPT' WHEN was THEN 'REJECT' WHEN act IS NOT NULL THEN act WHEN score >= lim THEN 'ACCEPT' WHEN score >= -lim THEN 'RETRY' ELSE 'REJECT' END AS outcome FROM y"""))
def p23(spark, d):
    c = F.col
    kind = F.when(c("seq") % 4 == 0, "security").when(c("seq") % 4 == 1, "lint").when(c("seq") % 4 == 2, "syntax").otherwise("other")
    action = F.when(c("seq") % 7 == 0, "ESCALATE")
    return decisions(spark, d).select("seq", control.evaluate(c("seq") % 3 == 0, c("seq") % 6 == 0, action, c("value") / 250 - 1, kind).alias("outcome"))


@query("p24_confidence_decision", with_views("decisions", body="SELECT seq, CASE WHEN review_verdict = 'wrong' OR coalesce(confidence, 0.5) < 0.5 THEN 'REJECT' WHEN coalesce(confidence, 0.5) >= CASE WHEN code IN ('E501', 'F401') AND patch_source = 'llm' THEN 0.70 WHEN seq % 5 = 0 THEN 0.95 ELSE 0.85 END THEN 'ACCEPT' ELSE 'NEEDS_REVIEW' END AS outcome FROM decisions"))
def p24(spark, d):
    safe = F.col("code").isin("E501", "F401") & (F.col("patch_source") == "llm")
    return decisions(spark, d).select("seq", control.confidence_decision(F.col("confidence"), F.col("review_verdict"), safe, F.when(F.col("seq") % 5 == 0, 0.9).otherwise(0.1)).alias("outcome"))


@query("p25_hard_constraints", with_views("decisions", body="SELECT seq, CASE WHEN a IS NULL THEN 'ALLOW' WHEN s >= 1 THEN a WHEN s >= 0.5 AND a = 'ESCALATE' THEN a ELSE 'ALLOW' END AS action FROM (SELECT seq, (seq % 3) / 2.0 AS s, CASE WHEN seq % 4 <> 0 AND confidence > 0.7 AND seq % 2 = 0 THEN 'ESCALATE' WHEN seq % 3 = 0 AND seq % 5 = 0 THEN 'REJECT' END AS a FROM decisions)"))
def p25(spark, d):
    c = F.col
    found = F.array(F.struct("confidence", F.when(c("seq") % 2 == 0, "high").otherwise("low").alias("severity")))
    action = control.hard_constraint(c("seq") % 4 == 0, found, c("seq") % 3 == 0, c("seq") % 5 != 0)
    return decisions(spark, d).withColumn("a", action).select("seq", control.soften(c("a"), (c("seq") % 3) / 2.0).alias("action"))


@query("p29_patch_score", with_views("findings", body="""+x AS (SELECT seq, lower(message) AS m, lower(concat('def fix import ', code)) AS p, CASE seq % 3 WHEN 0 THEN NULL WHEN 1 THEN concat('def fix import ', code) ELSE 'other' END AS known, concat('def fix import ', code) AS patch, confidence AS h FROM findings),
y AS (SELECT *, list_distinct(regexp_extract_all(m, '\\b[a-z_][a-z0-9_]*\\b')) AS names FROM x), z AS (SELECT *, len([n FOR n IN names IF contains(p, n)]) AS hits FROM y)
SELECT seq, round(0.35 * (CASE WHEN known IS NULL THEN 0.5 WHEN known = patch THEN 1.0 ELSE 0.3 END) + 0.25 * (CASE WHEN len(names) = 0 THEN 0.5 WHEN hits > 0 THEN 0.7 + 0.2 * hits / len(names) ELSE 0.3 END) + 0.20 * (CASE WHEN contains(m, 'import') OR contains(m, 'unresolved') THEN 1.0 WHEN contains(m, 'undefined') OR contains(m, 'cannot find') THEN 0.9 WHEN contains(m, 'type') AND (contains(m, 'mismatch') OR contains(m, 'expected')) AND contains(p, ':') THEN 0.8 ELSE 0.5 END) + 0.20 * coalesce(least(h, 1.0), 0.5), 9)::DOUBLE AS score FROM z"""))
def p29(spark, d):
    patch = F.concat(F.lit("def fix import "), "code")
    known = F.when(F.col("seq") % 3 == 1, patch).when(F.col("seq") % 3 == 2, "other")
    return findings(spark, d).select("seq", F.round(control.patch_score(known, patch, F.col("message"), F.col("confidence")), 9).alias("score"))


#: Health figures as doubles, from the windows of w2, w3 and w5.
GOVERNED_HEALTH = """a AS (SELECT seq, n, rb, fl, ac, mem, pat, slope, list_sum([CASE WHEN c = 0 THEN 0 ELSE -(c / n) * log2(c / n) END FOR c IN [c1, c2, c3, c4, c5]]) / 2.0 AS e FROM h),
b AS (SELECT seq, CASE WHEN n < 2 THEN 1.0 ELSE 1 - (rb + fl) / n END::DOUBLE AS stability, CASE WHEN n < 2 OR ac + rb = 0 THEN 1.0 ELSE ac / (ac + rb) END::DOUBLE AS success_rate, CASE WHEN n < 2 THEN 0.0 ELSE e END::DOUBLE AS entropy, CASE WHEN n < 2 OR pat = 0 THEN 0.0 ELSE mem / pat END::DOUBLE AS memory_rate, CASE WHEN n < 2 THEN 0.0 ELSE rb / n END::DOUBLE AS rollback_rate, CASE WHEN n < 2 THEN 0.0 ELSE greatest(-1.0, least(1.0, -coalesce(slope, 0) / 5.0)) END::DOUBLE AS trend FROM a),
r AS (SELECT d.project AS key, b.*, 0.2::DOUBLE * stability + 0.2::DOUBLE * trend + 0.15::DOUBLE * (1 - rollback_rate) + 0.15::DOUBLE * success_rate + 0.1::DOUBLE * memory_rate AS overall, row_number() OVER (PARTITION BY d.project ORDER BY b.seq) AS n FROM b JOIN decisions d ON d.seq = b.seq)"""


@query("p28_governor", with_views("decisions", body=f"+{HEALTH}, {GOVERNED_HEALTH}, {GOVERN} SELECT key AS project, seq, {ROUNDED} FROM g").replace("WITH ", "WITH RECURSIVE ", 1))
def p28(spark, d):
    h = _health(spark, d).withColumn("overall", 0.2 * F.col("stability") + 0.2 * F.col("trend") + 0.15 * (1 - F.col("rollback_rate")) + 0.15 * F.col("success_rate") + 0.1 * F.col("memory_rate"))
    out = control.govern(h.select("project", "seq", "stability", "success_rate", "entropy", "memory_rate", "rollback_rate", "trend", "overall"), "project", "seq")
    return out.selectExpr("project", "seq", *[f"{TO_MILLIONTHS.format(n)} AS {n}" for n in control.GOVERNED])


@query("w4_rates", with_views("decisions", body=f"+{HEALTH} SELECT count(*) AS n, sum((rb * 2 > n)::INT) AS mostly_rolled_back, sum((ac > rb)::INT) AS more_accepted FROM h"))
def w4(spark, d):
    from tallyloom.operators.streaks import over

    w = over(["project"], ["seq"], -9, 0)
    one = lambda v: F.sum(F.when(F.col("decision") == v, 1).otherwise(0)).over(w)
    rows = decisions(spark, d).select(one("REJECT").alias("rb"), one("ACCEPT").alias("ac"), F.count("*").over(w).alias("n"))
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("rb") * 2 > F.col("n")).alias("mostly_rolled_back"), F.count_if(F.col("ac") > F.col("rb")).alias("more_accepted"))


@query("o7_beam", """WITH c AS (SELECT o_custkey % 50 AS plan, 1 + o_orderkey % 2 AS step, o_orderkey AS choice, o_totalprice AS gain, row_number() OVER (PARTITION BY o_custkey % 50, o_orderkey % 2 ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders), a AS (SELECT * FROM c WHERE step = 1 AND k <= 6), p AS (SELECT a.plan, a.choice::VARCHAR || '>' || b.choice AS path, a.gain + b.gain AS total FROM a JOIN c b ON b.plan = a.plan AND b.step = 2 AND b.k <= 3)
SELECT plan, path, round(total, 4) AS total FROM (SELECT *, row_number() OVER (PARTITION BY plan ORDER BY total DESC, path) AS n FROM p) WHERE n <= 3""")
def o7(spark, d):
    from tallyloom.operators.ranking import top

    o = table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("plan"), (1 + F.col("o_orderkey") % 2).alias("step"), F.col("o_orderkey").alias("choice"), F.col("o_totalprice").alias("gain"))
    best = top(o, ["plan", "step"], 6, [F.desc("gain"), F.col("choice")]).filter("step = 1 OR place <= 3")
    return control.beam(best).select("plan", "path", F.round("total", 4).alias("total"))


@query("g1_import_edges", f"WITH {_snippet_sql()}, fs AS (SELECT DISTINCT file FROM sn), u AS (SELECT DISTINCT file AS src, regexp_extract(text, '^\\s*(?:import|from)\\s+([A-Za-z_]\\w*)', 1) AS m FROM sn) SELECT src, concat(m, '.py') AS dst FROM u WHERE m IN ('os', 'sys')")
def g1(spark, d):
    s = snippets(spark, d)
    files = s.groupBy("file").agg(F.array_join(F.collect_list("text"), "\n").alias("text"))
    known = spark.createDataFrame([("os.py", ""), ("sys.py", "")], "file string, text string")
    return code.python_edges(files.unionByName(known))


@query("j13_missing_packages", "SELECT DISTINCT concat('n', c_nationkey % 30) AS name FROM customer WHERE c_nationkey % 30 NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) AND c_nationkey % 30 NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 5 = 0)")
def j13(spark, d):
    used = table(spark, d, "customer").select(F.concat(F.lit("n"), F.col("c_nationkey") % 30).alias("name"))
    own = table(spark, d, "nation").filter("n_regionkey = 1").select(F.concat(F.lit("n"), "n_nationkey").alias("name"))
    listed = table(spark, d, "supplier").filter("s_suppkey % 5 = 0").select(F.concat(F.lit("n"), "s_nationkey").alias("name"))
    return graph.missing(used, own, listed)


C_SOURCE = "#define MAX_LEN 10\n#define ADD(a, b) \\\n  ((a) + \\\n   (b))\n/* #define HIDDEN 1 */\nint x = MAX_LEN; // #define NO 1\n#define lower_case 3"
PY = 'class A:\n    """Doc of A."""\n    def f(self, x, y=1):\n        """Doc of f."""\n        if x:\n            raise ValueError(x)\n        return y\n\ndef g():  # eval(x)\n    s = "# eval(y)"\n    return b"1" + b"22"\n'
PY2 = "class A:\n    def f(self, x, y, z):\n        print(x)\n        return None\n\ndef g():\n    return b'1'\n"


def _py(spark, d, text):
    return table(spark, d, "region").select(F.col("r_name").alias("file"), F.lit(text).alias("text"))


@query("x3_code_in_comments", "SELECT r_name AS file, 9 AS line FROM region")
def x3(spark, d):
    return code.code_in_comments(_py(spark, d, PY)).select("file", "line")


@query("x7_logic_changes", "SELECT r_name AS file, v.* FROM region, (VALUES ('f', 'REQUIRED_PARAM_ADDED', 'high'), ('f', 'CALL_REMOVED', 'medium'), ('f', 'CALL_ADDED', 'medium'), ('f', 'SIDE_EFFECT_ADDED', 'medium')) v(name, type, severity)")
def x7(spark, d):
    return code.logic_changes(code.functions_of(_py(spark, d, PY)), code.functions_of(_py(spark, d, PY2)))


@query("x8_docstrings", "SELECT r_name AS file, v.* FROM region, (VALUES ('A', 'class', 'Doc of A.', 1), ('f', 'function', 'Doc of f.', 3)) v(name, kind, doc, line)")
def x8(spark, d):
    return code.docstrings(_py(spark, d, PY)).drop("code")


@query("a20_literals", "SELECT r_name AS file, 2 AS before, 1 AS after FROM region")
def a20(spark, d):
    after = code.literal_counts(_py(spark, d, PY2)).select("file", F.col("bytes").alias("after"))
    return code.literal_counts(_py(spark, d, PY)).select("file", F.col("bytes").alias("before")).join(after, "file")


@query("a20_type_erosion", with_views("decisions", body="SELECT seq, seq % 2 = 0 AND code <> 'import-untyped' AS eroded FROM decisions"))
def a20e(spark, d):
    after = F.when(F.col("seq") % 2 == 0, "x = 1  # type: ignore").otherwise("x = 2")
    return decisions(spark, d).select("seq", code.erosion(F.lit("x = 1"), after, F.col("code")).alias("eroded"))


@query("x11_macros", "SELECT r_name AS file, v.* FROM region, (VALUES ('MAX_LEN', 1, 0), ('ADD', 2, 2), ('lower_case', 7, 0)) v(name, line, params)")
def x11(spark, d):
    return code.macros(_py(spark, d, C_SOURCE)).select("file", "name", "line", F.size("params").alias("params"))


@query("j14_relevant_macros", "SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'ADD,MAX_LEN' WHEN 1 THEN 'lower_case' ELSE 'MAX_LEN,ADD,lower_case' END AS macros FROM part")
def j14(spark, d):
    kind = F.col("p_partkey") % 3
    line = F.when(kind == 0, "y = ADD(1, MAX_LEN)").when(kind == 1, "y = lower_case").otherwise("y = lower_case + MAX_LEN")
    message = F.when(kind == 0, "MAX_LEN is odd").when(kind == 1, "bad").otherwise("in expansion of ADD")
    errors = table(spark, d, "part").select(F.col("p_partkey").alias("id"), line.alias("line_text"), message.alias("message"))
    return code.relevant_macros(errors, code.macros(_py(spark, d, C_SOURCE)))


@query("x13_changed_hunks", "SELECT p_partkey, CASE WHEN p_size % 9 < 5 THEN ['replace:1-2>1-2'] WHEN p_size % 9 = 8 THEN ['replace:8-9>8-9'] ELSE [] END AS hunks FROM part")
def x13(spark, d):
    before, after = F.lit("a\nb\nc\nd\ne\nf\ng\nh\ni"), F.lit("a\nB\nc\nd\ne\nf\ng\nh\nI")
    at = F.when(F.col("p_size") % 9 < 5, 2).when(F.col("p_size") % 9 == 8, 12).otherwise(30)
    return table(spark, d, "part").select("p_partkey", code.changed_hunks(before, after, at).alias("hunks"))


@query("s12_traceback", "SELECT p_partkey, concat('src/', p_name, '.py') AS file, p_size AS line, 'ValueError' AS code FROM part")
def s12(spark, d):
    log = F.concat(F.lit('Traceback (most recent call last):\n  File "/usr/lib/x.py", line 3, in a\n  File "src/'), "p_name", F.lit('.py", line '), F.col("p_size").cast("string"), F.lit(', in b\n  File "/usr/lib/y.py", line 9, in c\nValueError: bad'))
    return tools.tracebacks(table(spark, d, "part").select("p_partkey", log.alias("text"))).select("p_partkey", "file", "line", "code")


@query("s13_test_failures", "SELECT p_brand AS path, concat('test_', p_size) AS name, count(*) > 0 AS failed FROM part GROUP BY 1, 2")
def s13(spark, d):
    line = F.concat(F.lit("FAILED "), "p_brand", F.lit("::test_"), F.col("p_size").cast("string"), F.lit(" - assert 0"))
    return tools.test_failures(table(spark, d, "part").select(line.alias("value"))).select("path", "name", F.lit(True).alias("failed"))


@query("s8_rustc_json", with_views("findings", body="SELECT file, code, count(*) AS n FROM findings WHERE level = 'error' GROUP BY 1, 2"))
def s8(spark, d):
    doc = F.to_json(F.struct(F.lit("compiler-message").alias("reason"), F.struct("level", F.struct("code").alias("code"), "message", F.array(F.struct(F.col("file").alias("file_name"), F.col("line").alias("line_start"), F.col("col").alias("column_start"))).alias("spans")).alias("message")))
    return tools.rustc_messages(findings(spark, d).select(doc.alias("value"))).filter("severity = 'error'").groupBy("file", "code").agg(F.count("*").alias("n"))


@query("s22_compile_commands", "SELECT concat('f', p_partkey, '.c') AS file, concat('-I', p_brand) AS flag FROM part")
def s22(spark, d):
    doc = F.to_json(F.array(F.struct(F.concat(F.lit("f"), "p_partkey", F.lit(".c")).alias("file"), F.concat(F.lit("cc -c -I"), "p_brand", F.lit(" -O2 x.c")).alias("command"))))
    return tools.compile_commands(table(spark, d, "part").select(doc.alias("value"))).filter("flag LIKE '-I%'").select("file", "flag")


@query("k1_append_jsonl", with_views("decisions", body="SELECT project, count(*) AS n FROM decisions GROUP BY project"))
def k1(spark, d):
    path = shared_folder(spark, "sinks")
    rows = decisions(spark, d).select("project", "seq")
    sinks.append_jsonl(rows.filter("seq % 2 = 0"), path)
    sinks.append_jsonl(rows.filter("seq % 2 = 1"), path)
    return tools.read_jsonl(spark, path, "project string, seq long").groupBy("project").agg(F.count("*").alias("n"))


@query("k5_review_queue", with_views("findings", body="SELECT CASE WHEN code = 'F401' THEN 'import' WHEN code = 'E999' THEN 'syntax' WHEN code = 'W503' THEN 'logic' ELSE 'unknown' END AS category, count(*) AS n FROM findings GROUP BY 1"))
def k5(spark, d):
    path = shared_folder(spark, "sinks")
    rows = findings(spark, d).select("seq", control.review_category(F.col("code"), F.lit("")).alias("category"))
    sinks.review_queue(rows, path)
    return spark.read.parquet(path).groupBy("category").agg(F.count("*").alias("n"))


@query("k7_training_export", with_views("decisions", body="SELECT count(*) AS n FROM decisions"))
def k7(spark, d):
    path = shared_folder(spark, "sinks")
    rows = decisions(spark, d).select("code", F.lit("python").alias("language"), F.col("reason").alias("message"), F.array(F.lit("x")).alias("after_snippet"))
    sinks.export_text(mining.export_messages(rows), path)
    return spark.read.text(path).filter(F.get_json_object("value", "$.messages[1].role") == "assistant").agg(F.count("*").alias("n"))


@query("t6_incremental_rescan", with_views("before_scan", "after_scan", body="SELECT count(*) AS n FROM (SELECT seq FROM before_scan WHERE file NOT LIKE 'src/m1%' UNION ALL SELECT seq FROM after_scan WHERE file LIKE 'src/m1%')"))
def t6(spark, d):
    from tallyloom.operators.dedup import replace_files

    b, a = scans(spark, d)
    files = findings(spark, d).select("file").filter("file LIKE 'src/m1%'").distinct()
    return replace_files(b, a, files).agg(F.count("*").alias("n"))


@query("g7_related_definitions", with_views("edges", body="SELECT src, count(*) AS n, min(dst) AS first FROM edges GROUP BY src"))
def g7(spark, d):
    from tallyloom.operators.ranking import top

    rows = top(edges(spark, d), ["src"], 5, [F.col("dst")])
    return rows.groupBy("src").agg(F.count("*").alias("n"), F.min("dst").alias("first"))


@query("x_parsers_over_documents")
def parsers(spark, d):
    """What the parser-based scanners find in whole documents and snippets."""
    t = _source_texts(spark, d)
    count = lambda rows, kind: rows.groupBy("file").agg(F.count("*").alias("n")).withColumn("kind", F.lit(kind))
    found = [count(code.code_in_comments(t), "comments"), count(code.functions_of(t), "functions"), count(code.docstrings(t), "docstrings"), count(code.macros(t), "macros"), count(code.literal_counts(t), "literals")]
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


@query("s13_cargo_failures", """SELECT p_partkey, v.* FROM part, LATERAL (SELECT concat('tests::t', p_size) AS name, 'src/lib.rs' AS file, p_size AS line, concat('left != ', p_size) AS message WHERE p_partkey % 3 < 2 UNION ALL SELECT 'tests::other', 'src/a.rs', 7, 'oh no' WHERE p_partkey % 3 < 2 UNION ALL SELECT concat('tests::t', p_size), '', 0, 'test failed' WHERE p_partkey % 3 = 2) v""")
def s13c(spark, d):
    n = F.col("p_size").cast("string")
    old = F.concat(F.lit("---- tests::t"), n, F.lit(" stdout ----\nthread 'x' panicked at 'left != "), n, F.lit("', src/lib.rs:"), n, F.lit(":9\n---- tests::other stdout ----\nthread 'y' panicked at src/a.rs:7:1:\n  oh no\nfailures:\n    tests::other\n"))
    new = F.concat(F.lit("running 2 tests\n---- tests::t"), n, F.lit(" stdout ----\nthread 'x' panicked at src/lib.rs:"), n, F.lit(":9:\nleft != "), n, F.lit("\n---- tests::other stdout ----\nthread 'y' panicked at src/a.rs:7:1:\n  oh no\n"))
    names = F.concat(F.lit("x\n\nfailures:\n    tests::t"), n, F.lit("\n\ntest result: FAILED"))
    kind = F.col("p_partkey") % 3
    logs = table(spark, d, "part").select("p_partkey", F.when(kind == 0, old).when(kind == 1, new).otherwise(names).alias("text"))
    return tools.cargo_failures(logs).select("p_partkey", "name", "file", "line", "message")


@query("s13_jest_failures", "SELECT p_partkey, v.* FROM part, LATERAL (SELECT concat('math > adds ', p_size) AS name, 'test/math.test.js' AS file, p_size AS line, concat('expected ', p_size) AS message UNION ALL SELECT 'no frame', '', 0, 'test failed' WHERE p_partkey % 2 = 0) v")
def s13j(spark, d):
    n = F.col("p_size").cast("string")
    text = F.concat(F.lit("FAIL test/math.test.js\n  \u25cf math > adds "), n, F.lit("\n\n    expected "), n, F.lit("\n      at Object.<anonymous> (test/math.test.js:"), n, F.lit(":19)\n"), F.when(F.col("p_partkey") % 2 == 0, "  \u25cf no frame\n").otherwise(""))
    return tools.jest_failures(table(spark, d, "part").select("p_partkey", text.alias("text"))).select("p_partkey", "name", "file", "line", "message")
