"""Queries of row-level operators: signatures, classification, weights, scores, verdicts."""

from pyspark.sql import functions as F

from tallyloom.functions import rules, text
from tallyloom.operators import control, diff
from tallyloom.plans.adapters import decisions, findings, table, with_views
from tallyloom.plans.registry import query

NORM = r"""CASE WHEN n LIKE 'syntaxerror %' THEN substr(n, 13) ELSE n END"""
NORMAL = r"""normal AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(lower(message), '\d+', '', 'g'), '[^\w\s]', '', 'g'), '\s+', ' ', 'g')) AS n FROM findings), normed AS (SELECT *, CASE WHEN n LIKE 'syntaxerror %' THEN substr(n, 13) ELSE n END AS norm FROM normal)"""
CLASS = """classed AS (SELECT *, CASE WHEN level = 'warning' THEN 'CLEANUP'
  WHEN lower(message) LIKE '%unused%' OR lower(message) LIKE '%dead code%' OR lower(message) LIKE '%never used%' THEN 'CLEANUP'
  WHEN code LIKE 'clippy::%' THEN 'CLEANUP'
  WHEN lower(message) LIKE '%prefix%' AND lower(message) LIKE '%unknown%' THEN 'CRITICAL_SYNTAX'
  WHEN lower(message) LIKE '%expected one of%' OR lower(message) LIKE '%unexpected token%' OR lower(message) LIKE '%unclosed%' THEN 'CRITICAL_SYNTAX'
  WHEN lower(code) LIKE '%.security.%' OR lower(code) LIKE '%.audit.%' OR lower(code) LIKE '%security.audit%' THEN 'SECURITY' ELSE 'UNKNOWN' END AS cls FROM findings)"""
WEIGHT = "CASE {0} WHEN 'CRITICAL_SYNTAX' THEN 200.0 WHEN 'BLOCKING' THEN 100.0 WHEN 'SECURITY' THEN 90.0 WHEN 'STRUCTURAL' THEN 70.0 WHEN 'TEST_FAILURE' THEN 60.0 WHEN 'SEMANTIC_MISMATCH' THEN 55.0 WHEN 'CLEANUP' THEN 30.0 WHEN 'WARNING' THEN 10.0 WHEN 'BUILD_SCRIPT' THEN 150.0 WHEN 'MANIFEST' THEN 200.0 ELSE 50.0 END::DOUBLE"


def classed(spark, d):
    f = findings(spark, d)
    return f.withColumn("cls", rules.classify(F.col("file"), F.col("code"), F.col("level"), F.col("message")))


@query("p1_normalize_message", with_views("findings", body=f"+{NORMAL} SELECT norm, count(*) AS n FROM normed GROUP BY norm"))
def p1(spark, d):
    return findings(spark, d).groupBy(text.normalize_message(F.col("message")).alias("norm")).agg(F.count("*").alias("n"))


@query("p2_signature", with_views("findings", body=f"+{NORMAL} SELECT CASE WHEN code <> '' THEN concat_ws('::', file, code, substr(norm, 1, 80)) ELSE concat_ws('::', file, substr(norm, 1, 100)) END AS sig, count(*) AS n FROM normed GROUP BY 1"))
def p2(spark, d):
    return findings(spark, d).groupBy(text.signature(F.col("file"), F.col("code"), F.col("message")).alias("sig")).agg(F.count("*").alias("n"))


@query("p3_process_key", with_views("findings", body=f"+{NORMAL} SELECT concat(CASE WHEN code <> '' THEN concat_ws('::', file, code, substr(norm, 1, 80)) ELSE concat_ws('::', file, substr(norm, 1, 100)) END, '::L', line) AS k, count(*) AS n FROM normed GROUP BY 1"))
def p3(spark, d):
    return findings(spark, d).groupBy(text.process_key(F.col("file"), F.col("code"), F.col("message"), F.col("line")).alias("k")).agg(F.count("*").alias("n"))


@query("p4_identity", with_views("findings", body=r"""SELECT sha256(concat_ws('::', '1', 'default', 'instance', regexp_extract(file, '([^/]*)$', 1), CASE WHEN code <> '' THEN 'PRIMARY:' || code END, 'SECONDARY:' || trim(regexp_replace(regexp_replace(message, '\b\d+\b', '#', 'g'), '\s+', ' ', 'g')), CASE WHEN error_type <> '' THEN 'type=' || error_type END, 'line=' || line)) AS id, count(*) AS n FROM findings GROUP BY 1"""))
def p4(spark, d):
    f = findings(spark, d)
    return f.groupBy(text.identity(F.col("file"), F.col("code"), F.col("message"), F.col("error_type"), F.col("line")).alias("id")).agg(F.count("*").alias("n"))


@query("p5_ensure_fields", with_views("findings", body="SELECT seq, coalesce(error_type, 'unknown') AS error_type, coalesce(confidence, 1.0) AS confidence, coalesce(base_weight, CASE severity WHEN 'critical' THEN 100.0 WHEN 'error' THEN 10.0 WHEN 'warning' THEN 1.0 ELSE 0.0 END) AS base_weight FROM findings"))
def p5(spark, d):
    return findings(spark, d).select("seq", F.coalesce("error_type", F.lit("unknown")).alias("error_type"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"), F.coalesce("base_weight", rules.lookup(F.col("severity"), rules.SEVERITY_WEIGHT, 0.0)).alias("base_weight"))


@query("p6_classify", with_views("findings", body=f"+{CLASS} SELECT cls, code, count(*) AS n FROM classed GROUP BY 1, 2"))
def p6(spark, d):
    return classed(spark, d).groupBy("cls", "code").agg(F.count("*").alias("n"))


@query("p7_provider_rules", with_views("findings", body="SELECT code, CASE code WHEN 'E999' THEN 'CRITICAL_SYNTAX' WHEN 'F821' THEN 'BLOCKING' WHEN 'E0308' THEN 'BLOCKING' WHEN 'F401' THEN 'CLEANUP' WHEN 'E501' THEN 'CLEANUP' END AS cls, count(*) AS n FROM findings WHERE code IN ('E999', 'F821', 'E0308', 'F401', 'E501') GROUP BY 1, 2"))
def p7(spark, d):
    rows = [("E999", "CRITICAL_SYNTAX"), ("F821", "BLOCKING"), ("E0308", "BLOCKING"), ("F401", "CLEANUP"), ("E501", "CLEANUP")]
    table_ = spark.createDataFrame(rows, "code string, cls string")  # a rule table: one row per code
    return findings(spark, d).join(F.broadcast(table_), "code").groupBy("code", "cls").agg(F.count("*").alias("n"))


@query("p8_keep_class", with_views("findings", body=f"+{CLASS} SELECT CASE WHEN error_class IN ('SECURITY','BLOCKING','CRITICAL_SYNTAX','BUILD_SCRIPT','MANIFEST') AND cls NOT IN ('SECURITY','BLOCKING','CRITICAL_SYNTAX','BUILD_SCRIPT','MANIFEST') THEN error_class ELSE cls END AS kept, count(*) AS n FROM classed GROUP BY 1"))
def p8(spark, d):
    return classed(spark, d).groupBy(rules.keep_class(F.col("error_class"), F.col("cls")).alias("kept")).agg(F.count("*").alias("n"))


@query("p9_class_weight", with_views("findings", body=f"+{CLASS} SELECT cls, {WEIGHT.format('cls')} AS weight, count(*) AS n FROM classed GROUP BY 1, 2"))
def p9(spark, d):
    return classed(spark, d).groupBy("cls", rules.class_weight(F.col("cls")).alias("weight")).agg(F.count("*").alias("n"))


@query("p10_model_weight", with_views("findings", body="""SELECT seq, round(100.0 * tanh(greatest(0.0, coalesce(base_weight, 1.0)) * exp(-(CASE coalesce(error_type, '') WHEN 'security' THEN 3.0 WHEN 'syntax' THEN 2.5 WHEN 'type' THEN 2.0 WHEN 'lint' THEN 1.0 ELSE 2.0 END) * (1 - greatest(0.0, least(1.0, coalesce(confidence, 1.0))))) * (CASE coalesce(error_type, '') WHEN 'security' THEN 2.0 WHEN 'syntax' THEN 1.2 WHEN 'type' THEN 1.1 WHEN 'lint' THEN 0.3 ELSE 1.0 END) / 100.0), 6) AS weight FROM findings"""))
def p10(spark, d):
    return findings(spark, d).select("seq", F.round(rules.model_weight(F.col("base_weight"), F.col("error_type"), F.col("confidence")), 6).alias("weight"))


@query("p11_source_confidence", with_views("decisions", body="SELECT patch_source, CASE WHEN patch_source IN ('golden') THEN 0.95 WHEN patch_source IN ('memory', 'type_ignore') THEN 0.9 WHEN patch_source = 'correctr' THEN 0.85 WHEN patch_source = 'llm' OR patch_source LIKE 'llm\\_blocking\\_%' ESCAPE '\\' THEN 0.6 ELSE 0.5 END::DOUBLE AS confidence, count(*) AS n FROM decisions GROUP BY 1, 2"))
def p11(spark, d):
    return decisions(spark, d).groupBy("patch_source", rules.source_confidence(F.col("patch_source")).alias("confidence")).agg(F.count("*").alias("n"))


@query("p12_fallback_class", with_views("findings", body="SELECT CASE WHEN lower(message) LIKE '%expected one of%' OR lower(message) LIKE '%unknown prefix%' THEN 'CRITICAL_SYNTAX' ELSE 'UNKNOWN' END AS cls, count(*) AS n FROM findings GROUP BY 1"))
def p12(spark, d):
    return findings(spark, d).groupBy(rules.fallback_class(F.col("message")).alias("cls")).agg(F.count("*").alias("n"))


@query("p13_infer_language", with_views("findings", body="SELECT code, CASE WHEN regexp_matches(code, '^(CS|CA|IDE|SA|SX|IDISP)[0-9]') THEN 'csharp' WHEN code LIKE 'clippy::%' THEN 'rust' WHEN regexp_matches(code, '^(E|W|F|C|B|D|N|S|T|A|I)[0-9]') THEN 'python' WHEN code = 'name-defined' OR code LIKE 'python.%' THEN 'python' END AS language, count(*) AS n FROM findings GROUP BY 1, 2"))
def p13(spark, d):
    return findings(spark, d).groupBy("code", rules.infer_language(F.col("code"), F.lit("")).alias("language")).agg(F.count("*").alias("n"))


@query("p15_review_queue", with_views("findings", body=f"+{CLASS}, k AS (SELECT CASE WHEN code IN ('W503', 'W504') THEN 'logic' WHEN code = 'F401' THEN 'import' WHEN code = 'E999' THEN 'syntax' WHEN cls = 'SECURITY' THEN 'security' WHEN cls = 'CRITICAL_SYNTAX' THEN 'syntax' WHEN cls = 'CLEANUP' THEN 'formatting' ELSE 'unknown' END AS category FROM classed) SELECT category, CASE category WHEN 'security' THEN 1 WHEN 'logic' THEN 2 WHEN 'type' THEN 3 WHEN 'import' THEN 4 WHEN 'syntax' THEN 5 WHEN 'formatting' THEN 6 ELSE 7 END AS priority, count(*) AS n FROM k GROUP BY 1, 2"))
def p15(spark, d):
    rows = classed(spark, d).select(control.review_category(F.col("code"), F.col("cls")).alias("category"))
    return rows.groupBy("category", control.review_priority(F.col("category")).alias("priority")).agg(F.count("*").alias("n"))


@query("p19_symbols", with_views("findings", body=r"""SELECT array_to_string(list_concat(regexp_extract_all(message, '`([A-Za-z_][A-Za-z0-9_:.<>-]*)`', 1), regexp_extract_all(message, '''([A-Za-z_][A-Za-z0-9_:.<>-]*)''', 1)), ',') AS names, count(*) AS n FROM findings GROUP BY 1"""))
def p19(spark, d):
    return findings(spark, d).groupBy(F.array_join(text.symbols(F.col("message")), ",").alias("names")).agg(F.count("*").alias("n"))


@query("p20_decision_record", with_views("decisions", body="SELECT seq, CAST(trunc(TRY_CAST(concat(line, '.7') AS DOUBLE)) AS INT) AS line, substr(repeat(reason, 20), 1, 200) AS message, symbol_regression FROM decisions"))
def p20(spark, d):
    return decisions(spark, d).select("seq", F.expr("CAST(try_cast(concat(line, '.7') AS DOUBLE) AS INT) AS line"), F.substring(F.repeat("reason", 20), 1, 200).alias("message"), "symbol_regression")


SCORE_IN = "(value - 250) / 500 AS net, seq % 3 = 0 AS cb, seq % 4 <> 0 AS ca, seq % 5 = 0 AS sb, seq % 2 = 0 AS sa, seq % 7 = 0 AS lb, seq % 6 <> 0 AS la, seq % 80 AS size, seq % 3 AS files, seq % 9 AS iters"


@query("p21_score", with_views("decisions", body=f"""+i AS (SELECT seq, {SCORE_IN} FROM decisions) SELECT seq, round(CASE WHEN NOT ca AND cb THEN -1.0 ELSE greatest(-1.0, least(1.0, net + 1.5 * (CASE WHEN ca THEN 1 WHEN cb THEN -1 ELSE 0 END) + 2.0 * (CASE WHEN sa THEN 1 WHEN sb THEN -1 ELSE 0 END) + 0.5 * (CASE WHEN la THEN 1 WHEN lb THEN -1 ELSE 0 END)
  + 0.3 * ((CASE WHEN size > 10 THEN -0.1 ELSE 0 END) + (CASE WHEN size > 50 THEN -0.2 ELSE 0 END) + (CASE WHEN files > 1 THEN -0.3 ELSE 0 END)) + 0.2 * (-0.1 * least(iters, 5)))) END::DOUBLE, 9) AS score FROM i"""))
def p21(spark, d):
    c = F.col
    i = decisions(spark, d).selectExpr("seq", *SCORE_IN.split(", "))
    return i.select("seq", F.round(diff.score(c("net"), c("cb"), c("ca"), c("sb"), c("sa"), c("lb"), c("la"), c("size"), c("files"), c("iters")), 9).alias("score"))


@query("p22_thresholds", with_views("decisions", body="""+g AS (SELECT project, list(value / 250 - 1 ORDER BY value) FILTER (WHERE seq % 3 = 0) AS s, min(seq) % 4 AS depth, count(*) % 30 AS iters FROM decisions GROUP BY project),
t AS (SELECT *, len(s) AS n, greatest(0.5, 1.0 - depth * 0.1) AS f, least(0.2, ln(1 + iters::DOUBLE) * 0.05) AS p FROM g),
u AS (SELECT project, (CASE WHEN n >= 5 THEN greatest(0.24, s[floor(n * 0.66)::INT + 1]) ELSE 0.3 END) * f + p AS a, (CASE WHEN n >= 5 THEN least(-0.36, s[floor(n * 0.33)::INT + 1]) ELSE -0.3 END) * f - p * 0.5 AS r FROM t)
SELECT project, round(CASE WHEN r >= a THEN (a + r) / 2 + 0.05 ELSE a END, 9) AS accept, round(CASE WHEN r >= a THEN (a + r) / 2 - 0.05 ELSE r END, 9) AS retry FROM u"""))
def p22(spark, d):
    g = decisions(spark, d).groupBy("project").agg(F.collect_list(F.when(F.col("seq") % 3 == 0, F.col("value") / 250 - 1)).alias("s"), (F.min("seq") % 4).alias("depth"), (F.count("*") % 30).alias("iters"))
    a, r = diff.thresholds(F.col("s"), F.col("depth"), F.col("iters"))
    return g.select("project", F.round(a, 9).alias("accept"), F.round(r, 9).alias("retry"))


@query("p26_baseline_distance", with_views("decisions", body="SELECT seq, round((abs(value - 100) / greatest(value, 100.0, 1.0) + (CASE WHEN seq % 4 = 0 THEN 1.0 ELSE 0.0 END) + (CASE WHEN seq % 5 = 0 THEN 1.0 ELSE 0.0 END) + abs(error_count - 10) / greatest(error_count, 10, 1)) / 4, 9) AS distance FROM decisions"))
def p26(spark, d):
    c = F.col
    return decisions(spark, d).select("seq", F.round(control.baseline_distance(c("value"), c("seq") % 4 != 0, c("seq") % 5 != 0, c("error_count"), 100.0, 10), 9).alias("distance"))


@query("p30_project_outcome", with_views("decisions", body="""+g AS (SELECT project, count(*) FILTER (WHERE decision = 'ACCEPT') AS a, count(*) FILTER (WHERE decision = 'NEEDS_REVIEW') AS nr, sum(error_count) AS f, count(*) FILTER (WHERE decision = 'FAILED') > 40 AS failed FROM decisions GROUP BY project)
SELECT project, CASE WHEN failed THEN 'FAIL' WHEN f = 0 THEN 'EMPTY' WHEN a = 0 THEN 'PARTIAL' ELSE 'PASS' END AS outcome, (2 * a + 0.5 * nr + (CASE WHEN failed THEN -3 ELSE 1 END))::DOUBLE AS score FROM g"""))
def p30(spark, d):
    from tallyloom.operators.stats import project_outcome

    g = decisions(spark, d).groupBy("project").agg(F.count_if(F.col("decision") == "ACCEPT").alias("a"), F.count_if(F.col("decision") == "NEEDS_REVIEW").alias("nr"), F.sum("error_count").alias("f"), (F.count_if(F.col("decision") == "FAILED") > 40).alias("failed"))
    o, s = project_outcome(F.col("a"), F.col("nr"), F.col("f"), F.col("failed"))
    return g.select("project", o.alias("outcome"), s.cast("double").alias("score"))


@query("p32_versions", with_views("decisions", body="SELECT seq, concat('3.', seq % 14) AS spec, seq % 14 >= 9 AS new_enough FROM decisions"))
def p32(spark, d):
    spec = F.concat(F.lit("3."), F.col("seq") % 14)
    found = F.array_max(F.transform(F.regexp_extract_all(F.concat(F.lit(">=2.7,>="), spec), F.lit(r"(\d+\.\d+)"), 1), lambda v: F.struct(F.split(v, "\\.")[0].cast("int").alias("a"), F.split(v, "\\.")[1].cast("int").alias("b"))))
    return decisions(spark, d).select("seq", spec.alias("spec"), (found >= F.struct(F.lit(3).alias("a"), F.lit(9).alias("b"))).alias("new_enough"))


@query("p34_recipe_lookup", with_views("findings", body="SELECT code, CASE code WHEN 'E501' THEN 'wrap' WHEN 'F401' THEN 'remove import' WHEN 'W503' THEN 'auto' END AS advice, count(*) AS n FROM findings GROUP BY 1, 2"))
def p34(spark, d):
    manual = spark.createDataFrame([("E501", "wrap"), ("F401", "remove import")], "code string, manual string")
    auto = spark.createDataFrame([("E501", "auto"), ("W503", "auto")], "code string, auto string")
    f = findings(spark, d).join(F.broadcast(manual), "code", "left").join(F.broadcast(auto), "code", "left")  # rule tables: one row per code
    return f.groupBy("code", F.coalesce("manual", "auto").alias("advice")).agg(F.count("*").alias("n"))


@query("f7_noise", with_views("findings", body="SELECT seq FROM findings WHERE NOT (seq % 5 = 0 OR (seq % 5 = 1 AND seq % 3 = 0))"))
def f7(spark, d):
    code = F.when(F.col("seq") % 5 == 0, "CA1303").when((F.col("seq") % 5 == 1) & (F.col("seq") % 3 == 0), "IDE0051").when(F.col("seq") % 5 == 2, "IDEX").otherwise("CS0246")
    return findings(spark, d).filter(~rules.noise(code)).select("seq")


@query("p14_flake8_types", with_views("findings", body="SELECT code, CASE WHEN code LIKE 'E999%' THEN 'syntax' WHEN code LIKE 'E%' THEN 'compile' WHEN code LIKE 'W%' THEN 'warning' WHEN code LIKE 'F%' THEN CASE WHEN lower(message) LIKE '%undefined%' OR lower(message) LIKE '%name%' THEN 'runtime' WHEN lower(message) LIKE '%import%' THEN 'dependency' ELSE 'lint' END ELSE 'lint' END AS type, count(*) AS n FROM findings GROUP BY 1, 2"))
def p14(spark, d):
    return findings(spark, d).groupBy("code", rules.finding_type("flake8", F.col("code"), F.col("message")).alias("type")).agg(F.count("*").alias("n"))


@query("p14_rustc_types", with_views("findings", body="+x AS (SELECT message, CASE seq % 5 WHEN 0 THEN 'E0308' WHEN 1 THEN 'E0277' WHEN 2 THEN 'E0433' WHEN 3 THEN 'E0596' ELSE 'E0599' END AS code FROM findings) SELECT CASE code WHEN 'E0308' THEN 'type_mismatch' WHEN 'E0277' THEN 'trait_not_satisfied' WHEN 'E0433' THEN 'dependency' WHEN 'E0596' THEN 'mutability_error' ELSE 'unresolved_method' END AS type, count(*) AS n FROM x GROUP BY 1"))
def p14r(spark, d):
    code = F.element_at(F.array(*[F.lit(x) for x in ("E0308", "E0277", "E0433", "E0596", "E0599")]), (F.col("seq") % 5 + 1).cast("int"))
    return findings(spark, d).groupBy(rules.finding_type("rustc", code, F.col("message")).alias("type")).agg(F.count("*").alias("n"))


@query("p14_tsc_types", with_views("findings", body="SELECT CASE seq % 4 WHEN 0 THEN 'syntax' WHEN 1 THEN 'dependency' WHEN 2 THEN 'type' ELSE 'unknown' END AS type, count(*) AS n FROM findings GROUP BY 1"))
def p14t(spark, d):
    code = F.element_at(F.array(*[F.lit(x) for x in ("TS1005", "TS2307", "TS2345", "TS9999")]), (F.col("seq") % 4 + 1).cast("int"))
    return findings(spark, d).groupBy(rules.finding_type("tsc", code, F.col("message")).alias("type")).agg(F.count("*").alias("n"))


@query("p14_gcc_types", with_views("findings", body="SELECT CASE seq % 4 WHEN 0 THEN 'syntax' WHEN 1 THEN 'dependency' WHEN 2 THEN 'compile' ELSE 'unknown' END AS type, count(*) AS n FROM findings GROUP BY 1"))
def p14g(spark, d):
    message = F.element_at(F.array(*[F.lit(x) for x in ("expected ';' before", "x.h: No such file", "'y' was not declared", "odd")]), (F.col("seq") % 4 + 1).cast("int"))
    return findings(spark, d).groupBy(rules.finding_type("gcc", rules.synthetic_code(message), message).alias("type")).agg(F.count("*").alias("n"))


@query("f8_skip_paths", "SELECT p_partkey, concat('a/', p_brand, '/', CASE p_partkey % 3 WHEN 0 THEN 'venv' WHEN 1 THEN 'src' ELSE 'venv2' END) AS path FROM part WHERE p_partkey % 3 <> 0")
def f8(spark, d):
    path = F.concat_ws("/", F.lit("a"), "p_brand", F.when(F.col("p_partkey") % 3 == 0, "venv").when(F.col("p_partkey") % 3 == 1, "src").otherwise("venv2"))
    rows = table(spark, d, "part").select("p_partkey", path.alias("path"))
    return rows.filter(~F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(x) for x in ("venv", ".git", "node_modules")])))


@query("f10_live_files", with_views("decisions", body="SELECT DISTINCT concat(CASE user_id % 4 WHEN 0 THEN 'tests/' WHEN 1 THEN './docs/' WHEN 2 THEN 'lib/tests/' ELSE '' END, file) AS path FROM decisions WHERE user_id % 4 > 1"))
def f10(spark, d):
    u = F.col("user_id") % 4
    path = F.concat(F.when(u == 0, "tests/").when(u == 1, "./docs/").when(u == 2, "lib/tests/").otherwise(""), F.col("file"))
    return decisions(spark, d).select(path.alias("path")).filter(rules.live(F.col("path"))).distinct()


@query("f15_non_blocking", with_views("findings", body="SELECT count(*) FILTER (WHERE code LIKE 'clippy%' OR lower(message) LIKE '%unused import%' OR lower(message) LIKE '%dead code%' OR lower(message) LIKE '%never used%') AS non_blocking, count(*) AS n FROM findings"))
def f15(spark, d):
    return findings(spark, d).agg(F.count_if(rules.non_blocking(F.col("code"), F.col("message"))).alias("non_blocking"), F.count("*").alias("n"))


@query("x14_edit_distance", "SELECT a.p_partkey, levenshtein(a.p_name, b.p_name) AS distance FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def x14(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name")
    other = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("next"))
    return p.join(other, "p_partkey").select("p_partkey", F.levenshtein("p_name", "next").alias("distance"))
