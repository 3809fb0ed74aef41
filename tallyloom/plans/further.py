"""Queries of package inference, import edges of Rust and JavaScript, symbol indices, further tool formats, training rows and keyed streams."""

from pyspark.sql import functions as F

from tallyloom.functions import rules
from tallyloom.operators import code, mining, packages, symbols
from tallyloom.plans.adapters import decisions, findings, table, with_views
from tallyloom.plans.folders import shared_folder
from tallyloom.plans.registry import query
from tallyloom.plans.texts import TEXT, _drain, _lines_sql, _snippet_sql, _texts, quoted, snippets, source_lines
from tallyloom.sources import tools
from tallyloom.streaming import events as streaming


def pick(choices, n):
    return F.get(F.array(*[F.lit(c) for c in choices]), (n % len(choices)).cast("int"))


def pick_sql(choices, n: str) -> str:
    return f"CASE {n} % {len(choices)} " + " ".join(f"WHEN {i} THEN {quoted(c)}" for i, c in enumerate(choices)) + " END"


# --- packages ---

RUST = (
    "use serde::{Serialize, Deserialize};", "use std::time;", "let t = time::now();", "pub use crate::config::Settings;", "config::load()", "#[derive(Debug, Serialize)]", "#[derive(Parser)]", "#[tokio::main]", "#[serde(rename = \"x\")]",
    "extern crate rand;", "mod helper;", "helper::run();", "let r = regex::Regex::new(x); // anyhow::x", "use unknown_thing::Y;", "#[inline]", "fn main() {}", "let v = Player::new();", "    use itertools::Itertools;",
)
MANIFEST = ("[package]", "name = \"x\"", "[dependencies]", "serde-json = \"1\"", "rand = \"0.8\"", "# anyhow = \"1\"", "[dev-dependencies]", "itertools.workspace = true", "[features]", "regex = []")
CRATES_SQL = f"""WITH t AS (SELECT p_brand AS project, p_partkey AS n, split_part({pick_sql(RUST, 'p_partkey')}, '//', 1) AS t, {pick_sql(MANIFEST, 'p_partkey')} AS m, concat('src/', CASE p_size % 3 WHEN 0 THEN 'main' WHEN 1 THEN 'player/mod' ELSE 'tools' END, '.rs') AS file FROM part),
u AS (SELECT *, regexp_extract(t, '{packages.USE}', 1) AS root FROM t),
used AS (SELECT project, root AS name FROM u UNION SELECT project, regexp_extract(t, '{packages.EXTERN}', 1) FROM t UNION SELECT project, unnest(regexp_extract_all(t, '{packages.PATH}', 1)) FROM t),
own AS (SELECT project, unnest(regexp_extract_all(split_part(regexp_extract(t, 'use(.*)$', 1), ';', 1), '[A-Za-z_][A-Za-z0-9_]*')) AS name FROM u WHERE root IN ('crate', 'self', 'super', 'std', 'core', 'alloc', 'Self')
 UNION SELECT project, regexp_extract(t, '{packages.MODULE}', 1) FROM t UNION SELECT project, CASE WHEN file LIKE '%tools.rs' THEN 'tools' WHEN file LIKE '%/mod.rs' THEN 'player' END FROM t),
d AS (SELECT project, trim(unnest(string_split(regexp_extract(t, '{packages.DERIVE}', 1), ','))) AS name FROM t),
need AS (SELECT project, name, NULL AS feature FROM used WHERE name NOT IN ('', 'crate', 'self', 'super', 'std', 'core', 'alloc', 'Self') AND (project, name) NOT IN (SELECT project, name FROM own WHERE name IS NOT NULL)
 UNION SELECT project, CASE WHEN name IN ('Serialize', 'Deserialize') THEN 'serde' WHEN name = 'Error' THEN 'thiserror' ELSE 'clap' END, CASE WHEN name <> 'Error' THEN 'derive' END FROM d WHERE name IN ('Serialize', 'Deserialize', 'Parser', 'Subcommand', 'Args', 'ValueEnum', 'Error')
 UNION SELECT project, a, NULL FROM (SELECT project, unnest(regexp_extract_all(t, '{packages.ATTRIBUTE}', 1)) AS a FROM t) WHERE a IN ('serde', 'tokio', 'clap')),
p AS (SELECT *, last_value(CASE WHEN m LIKE '[%]' THEN m END IGNORE NULLS) OVER (PARTITION BY project ORDER BY n) AS part FROM t),
listed AS (SELECT project, replace(regexp_extract(m, '^([A-Za-z0-9_-]+)\\s*[.=]', 1), '-', '_') AS name FROM p WHERE part LIKE '%dependencies]' AND m NOT LIKE '[%')
SELECT project, name, CASE WHEN name IN ('serde', 'tokio', 'clap', 'rand', 'regex', 'itertools') THEN CASE name WHEN 'clap' THEN '4' WHEN 'rand' THEN '0.8' WHEN 'itertools' THEN '0.12' ELSE '1' END END AS version,
 CASE WHEN name IN ('serde', 'tokio', 'clap', 'rand', 'regex', 'itertools') THEN CASE WHEN name = 'tokio' THEN 'full' ELSE coalesce(max(feature), '') END END AS features FROM need WHERE (project, name) NOT IN (SELECT project, name FROM listed) GROUP BY project, name"""


@query("j13_missing_crates", CRATES_SQL)
def j13_crates(spark, d):
    n = F.col("p_partkey")
    file = F.concat(F.lit("src/"), pick(("main", "player/mod", "tools"), F.col("p_size")), F.lit(".rs"))
    rows = table(spark, d, "part").select(F.col("p_brand").alias("project"), n.alias("line"), file.alias("file"), pick(RUST, n).alias("text"), pick(MANIFEST, n).alias("m"))
    listed = packages.rust_manifest(rows.select("project", "line", F.col("m").alias("text")), ["project"])
    return packages.missing_crates(packages.rust_names(rows, ["project"]), listed, ["project"])


@query("j13_missing_by_prefix", """WITH u AS (SELECT DISTINCT p_brand AS project, concat('Lib', p_size % 7, '.Data.N', p_partkey % 3) AS name, p_size % 7 AS k FROM part), b AS (SELECT project, name, CASE WHEN k = 1 THEN 'Lib1.Sql' WHEN k < 5 THEN concat('Lib', k) END AS package FROM u)
SELECT project, package, min(name) AS via FROM b WHERE package IS NOT NULL AND package <> 'Lib3' GROUP BY project, package""")
def j13_prefix(spark, d):
    rows = table(spark, d, "part").select(F.col("p_brand").alias("project"), F.concat(F.lit("Lib"), F.col("p_size") % 7, F.lit(".Data.N"), F.col("p_partkey") % 3).alias("name"))
    known = spark.createDataFrame([*[(f"Lib{k}", f"Lib{k}") for k in range(5)], ("Lib1.Data", "Lib1.Sql")], "prefix string, package string")
    return packages.missing_by_prefix(rows, rows.select("project", F.lit("LIB3").alias("name")).distinct(), known, ["project"])


# --- edges and symbols ---


@query("g1_rust_edges", """WITH f AS (SELECT p_partkey AS n, concat('c', p_partkey % 40, CASE p_partkey % 3 WHEN 0 THEN '/src/m' ELSE '/src/k' END, p_partkey, CASE WHEN p_partkey % 5 = 0 THEN '/mod.rs' ELSE '.rs' END) AS file FROM part)
SELECT a.file AS src, b.file AS dst FROM f a JOIN f b ON b.n = a.n + 40 WHERE a.n % 5 <> 0 AND b.n % 3 = 0""")
def g1_rust(spark, d):
    n = F.col("p_partkey")
    folder = F.concat(F.lit("c"), n % 40, F.when(n % 3 == 0, "/src/m").otherwise("/src/k"), n)
    text = F.concat(F.lit("// files beside this one\nmod m"), n + 40, F.lit(";\n  mod absent;\nmod inner { }\nuse m"), n + 1, F.lit(";"))
    files = table(spark, d, "part").select(F.concat(folder, F.when(n % 5 == 0, "/mod.rs").otherwise(".rs")).alias("file"), text.alias("text"))
    return code.rust_edges(files)


@query("g1_js_edges", """WITH f AS (SELECT p_partkey AS n, concat('app/s', p_partkey % 40, '/w', p_partkey, CASE p_partkey % 4 WHEN 0 THEN '/index.js' WHEN 1 THEN '.ts' WHEN 2 THEN '.js' ELSE '.css' END) AS file FROM part)
SELECT a.file AS src, b.file AS dst FROM f a JOIN f b ON b.n = a.n + 4 AND b.n % 4 <> 3 WHERE a.n % 4 IN (1, 2) UNION SELECT a.file, b.file FROM f a JOIN f b ON b.n = a.n + 40 WHERE a.n % 4 IN (1, 2)""")
def g1_js(spark, d):
    n = F.col("p_partkey")
    file = F.concat(F.lit("app/s"), n % 40, F.lit("/w"), n, pick(("/index.js", ".ts", ".js", ".css"), n))
    text = F.concat(F.lit("import React from 'react';\nimport { a } from '../s"), (n + 4) % 40, F.lit("/./w"), n + 4, F.lit("?raw';\nconst b = require(\"./w"), n + 40, pick(("", ".ts", "", ""), n), F.lit("\");\nimport c from '../../../../out';"))
    return code.js_edges(table(spark, d, "part").select(file.alias("file"), text.alias("text")))


def _index_sql(shapes) -> str:
    parts = []
    for p, kind, name in shapes:
        k = f"regexp_extract(text, {quoted(p)}, {kind})" if isinstance(kind, int) else quoted(kind)
        parts.append(f"SELECT file, line, regexp_extract(text, {quoted(p)}, {name}) AS name, {k} AS kind, substr(trim(text), 1, 200) AS signature FROM sn WHERE regexp_matches(text, {quoted(p)})")
    return f"WITH {_lines_sql()} " + " UNION ALL ".join(parts)


def _index(language):
    return lambda spark, d: code.symbol_index(source_lines(spark, d), language)


for _language, _shapes in code.SYMBOLS.items():
    query("x9_symbol_index" + ("" if _language == "python" else "_" + _language), _index_sql(_shapes))(_index(_language))


RS = "//! About.\n\n/// Doc of\n///  f.\n#[inline]\npub fn f(x: i32) -> i32 {\n    x\n}\n/// Lost\nlet y = 1;\n/// S\nstruct S;\n"
JS = "/** Doc of f.\n * More.\n */\n\nexport async function f(x) {\n  return x;\n}\n/** Lost */\nx = 1;\n/** C */\nclass C { }\n/** m */ \nconst m = (a) => a;\n"


@query("x8_docstrings_rust", "SELECT r_name AS file, v.* FROM region, (VALUES ('f', 'fn', concat('Doc of', chr(10), ' f.'), 6, concat('pub fn f(x: i32) -> i32 {', chr(10), '    x', chr(10), '}')), ('S', 'struct', 'S', 12, 'struct S;')) v(name, kind, doc, line, code)")
def x8_rust(spark, d):
    return code.docstrings(table(spark, d, "region").select(F.col("r_name").alias("file"), F.lit(RS).alias("text")), "rust")


@query("x8_docstrings_js", "SELECT r_name AS file, v.* FROM region, (VALUES ('f', 'function', concat('Doc of f.', chr(10), 'More.'), 5, concat('export async function f(x) {', chr(10), '  return x;', chr(10), '}')), ('C', 'class', 'C', 11, 'class C { }'), ('m', 'function', 'm', 13, 'const m = (a) => a;')) v(name, kind, doc, line, code)")
def x8_js(spark, d):
    return code.docstrings(table(spark, d, "region").select(F.col("r_name").alias("file"), F.lit(JS).alias("text")), "js")


def _lost_sql(shapes) -> str:
    every = lambda t, patterns: "list_distinct(list_concat(" + ", ".join(["[]::VARCHAR[]", *[f"regexp_extract_all({t}, {quoted(p)}, 1)" for p in patterns]]) + "))"
    parts = [f"SELECT file, '{kind}' AS kind, unnest({every('before', p)}) AS name, {every('after', p)} AS there FROM t" for kind, p in shapes.items()]
    return f"WITH {_lines_sql()}, sp AS (SELECT CASE WHEN file LIKE 'f%' THEN concat('p', line // 4) ELSE file END AS file, line, text FROM sn), {TEXT[1:].replace('FROM sn', 'FROM sp')}, b AS ({' UNION ALL '.join(parts)}) SELECT file, kind, name FROM b WHERE NOT list_contains(there, name)"


def _lost(language):
    def run(spark, d):
        # the snippets as texts of four lines, so that most symbols are there once
        t = _texts(spark, d, lambda lines: lines.withColumn("file", F.when(F.col("file").startswith("f"), F.concat(F.lit("p"), F.floor(F.col("line") / 4))).otherwise(F.col("file"))))
        return symbols.lost(t.select("file", F.col("before").alias("text")), t.select("file", F.col("after").alias("text")), language).select("file", "kind", "name")

    return run


for _language, _shapes in symbols.SHAPES.items():
    query(f"u6_lost_{_language}", _lost_sql(_shapes))(_lost(_language))
query("u6_lost_python")(_lost("python"))

RELATED_SQL = f"""WITH {_snippet_sql()}, i AS (SELECT file, line, unnest([regexp_extract(text, {quoted(code.SYMBOLS['python'][0][0])}, 1), regexp_extract(text, {quoted(code.SYMBOLS['python'][1][0])}, 1)]) AS name FROM sn),
q AS (SELECT p_partkey AS id, concat('f', p_size % 10) AS own, unnest(['load_all', 'Reader', 'first', 'later', 'absent_name']) AS name, unnest([1, 2, 3, 4, 5]) AS n FROM part),
c AS (SELECT id, n, q.name, file, line, file = own AS same_file, row_number() OVER (PARTITION BY id, q.name ORDER BY file = own, file, line) AS k FROM q JOIN i ON i.name = q.name)
SELECT id, row_number() OVER (PARTITION BY id ORDER BY n)::INT AS place, name, file, line, same_file FROM c WHERE k = 1"""


@query("g7_related_symbols", RELATED_SQL)
def g7_symbols(spark, d):
    lines = snippets(spark, d)
    message = F.lit("`load_all` and 'Reader' of class Reader lack absent_name; method later and class Box, fn first, def, self")
    asked = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("f"), F.col("p_size") % 10).alias("file"), message.alias("message"))
    return symbols.related_definitions(asked, code.symbol_index(lines, "python"), lines).select("id", "place", "name", "file", "line", "same_file")


# --- tool formats ---


@query("s9_clang_tidy", with_views("findings", body="SELECT file, CASE WHEN seq % 4 = 1 THEN 'error' ELSE 'warning' END AS severity, concat('bugprone-x', seq % 5) AS code, count(*) AS n, sum(line) AS lines FROM findings WHERE seq % 4 < 2 GROUP BY 1, 2, 3"))
def s9_tidy(spark, d):
    kind = pick((": warning: bad [", ": error: bad [", ": note: bad [", ": error: bad [clang-diagnostic-error,"), F.col("seq"))
    line = F.concat("file", F.lit(":"), "line", F.lit(":"), "col", kind, F.lit("bugprone-x"), F.col("seq") % 5, F.lit(",cert-y]"))
    return tools.parse_text(findings(spark, d).select(line.alias("value")), "clang_tidy").groupBy("file", "severity", "code").agg(F.count("*").alias("n"), F.sum("line").alias("lines"))


@query("s9_cppcheck", with_views("findings", body="SELECT file, CASE seq % 4 WHEN 0 THEN 'error' WHEN 1 THEN 'warning' ELSE 'note' END AS severity, 'cppcheck::nullPointer' AS code, count(*) AS n, sum(line) AS lines, sum(col) AS cols FROM findings WHERE seq % 4 < 3 GROUP BY 1, 2"))
def s9_cppcheck(spark, d):
    name = F.when(F.col("seq") % 4 == 3, "cstyleCast").otherwise("nullPointer")
    place = F.concat(F.lit('<location file="'), "file", F.lit('" line="'), "line", F.lit('" column="'), "col", F.lit('"/><location file="other" line="1"/>'))
    doc = F.concat(F.lit('<results version="2"><cppcheck version="2"/><errors><error id="'), name, F.lit('" severity="'), pick(("error", "style", "information", "error"), F.col("seq")), F.lit('" msg="Null &lt;p&gt;">'), place, F.lit('</error><error id="syntaxError" severity="error" msg="no place"/></errors></results>'))
    return tools.cppcheck_findings(findings(spark, d).select(doc.alias("value"))).groupBy("file", "severity", "code").agg(F.count("*").alias("n"), F.sum("line").alias("lines"), F.sum("col").alias("cols"))


@query("s8_clippy", with_views("findings", body="SELECT file, code, 'warning' AS severity, 'clippy' AS tool, count(*) AS n FROM findings WHERE level IN ('error', 'warning') AND seq % 7 <> 0 GROUP BY 1, 2"))
def s8_clippy(spark, d):
    spans = F.when(F.col("seq") % 7 == 0, F.expr("cast(array() AS array<struct<file_name: string, line_start: int>>)")).otherwise(F.array(F.struct(F.col("file").alias("file_name"), F.col("line").cast("int").alias("line_start"))))
    doc = F.to_json(F.struct(F.lit("compiler-message").alias("reason"), F.struct("level", F.struct("code").alias("code"), "message", spans.alias("spans")).alias("message")))
    return tools.rustc_messages(findings(spark, d).select(doc.alias("value")), lint=True).groupBy("file", "code", "severity", "tool").agg(F.count("*").alias("n"))


@query("s8_cargo_audit", "SELECT p_partkey, concat('RUSTSEC-', p_partkey) AS code, concat('Bad: time-', p_size, ' 1.', p_size) AS message, CASE WHEN p_size % 3 = 0 THEN 3 WHEN p_size % 3 = 1 THEN 2 ELSE 0 END AS line, CASE WHEN p_size % 2 = 0 THEN concat('0.', p_size, '.4') WHEN p_size % 3 = 0 THEN '9.0.1' END AS fix_version FROM part")
def s8_audit(spark, d):
    size = F.col("p_size").cast("string")
    versions = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("^ 1"), F.concat(F.lit(">=0."), size, F.lit(".4")), F.lit(">=8.8.8"))).otherwise(F.array().cast("array<string>"))
    legacy = F.when(F.col("p_size") % 3 == 0, F.array(F.lit("9.0.1")))
    found = F.struct(F.struct(F.concat(F.lit("RUSTSEC-"), "p_partkey").alias("id"), F.lit("Bad").alias("title"), legacy.alias("patched")).alias("advisory"), F.struct(F.concat(F.lit("time-"), size).alias("name"), F.concat(F.lit("1."), size).alias("version")).alias("package"), F.struct(versions.alias("patched")).alias("versions"))
    p = table(spark, d, "part")
    docs = p.select("p_partkey", F.to_json(F.struct(F.struct(F.array(found).alias("list")).alias("vulnerabilities"))).alias("value"))
    lines = F.array(F.concat(F.lit("[dependencies."), size, F.lit("time]")), F.when(F.col("p_size") % 3 == 1, F.concat(F.lit("my-time-"), size, F.lit("-x = 1"))).otherwise(""), F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("time-"), size, F.lit(" = 1"))).otherwise(""))
    manifests = p.select("p_partkey", F.posexplode(lines).alias("n", "text")).select("p_partkey", (F.col("n") + 1).alias("line"), "text")
    return tools.cargo_audit(docs, manifests, ["p_partkey"]).select("p_partkey", "code", "message", "line", "fix_version")


@query("s19_verify_records", with_views("decisions", body="SELECT file, decision AS verdict, count(*) AS n FROM decisions GROUP BY 1, 2"))
def s19(spark, d):
    doc = F.to_json(F.struct(F.array(F.struct("file", "code", F.col("decision").alias("verdict"))).alias("verify_accepts")))
    return tools.verify_records(decisions(spark, d).select(doc.alias("value"))).groupBy("file", "verdict").agg(F.count("*").alias("n"))


# --- types of findings, strength of fixes ---

SAID = {
    "go": ("undefined: x", "Syntax Error: unexpected y", "expected }", "cannot use a as b in c", "x declared but not used", "could not import z", "fine", "undefined: a, imported and not used"),
    "javac": ("';' expected", "class, interface, or enum expected", "cannot find symbol", "package a.b does not exist", "[unchecked] x", "fine", "incompatible types: ';' expected"),
    "kotlin": ("unresolved reference: x", "argument type mismatch", "expecting ')'", "variable 'x' is never used", "only safe (?.) or non-null", "fine", "deprecated: too many arguments"),
}
TYPES = {
    "go": ("resolve", "syntax", "syntax", "type", "warning", "dependency", "unknown", "resolve"), "javac": ("syntax", "syntax", "resolve", "dependency", "warning", "unknown", "syntax"), "kotlin": ("resolve", "type", "syntax", "warning", "null_safety", "unknown", "type"),
}
CODED = {
    "ruff": (("SIM102", "S101", "PLE1", "B006", "X1", "", "UP006", "C401"), ("lint", "security", "compile", "compile", "lint", "lint", "lint", "lint")),
    "dotnet": (("CS1002", "CS0246", "CS8602", "CS1061", "IDE0051", "CAx", "CS0999", "CS9999", "VSTHRD100", "S12"), ("syntax", "dependency", "nullable", "type", "style", "unknown", "compile", "unknown", "concurrency", "lint")),
}


def _types(tool, code_of, message_of):
    return lambda spark, d: findings(spark, d).select("seq", rules.finding_type(tool, code_of(F.col("seq")), message_of(F.col("seq"))).alias("type"))


for _tool, _said in SAID.items():
    query(f"p14_{_tool}_types", with_views("findings", body=f"SELECT seq, {pick_sql(TYPES[_tool], 'seq')} AS type FROM findings"))(_types(_tool, lambda n: F.lit(None).cast("string"), lambda n, s=_said: pick(s, n)))
for _tool, (_codes, _kinds) in CODED.items():
    query(f"p14_{_tool}_types", with_views("findings", body=f"SELECT seq, {pick_sql(_kinds, 'seq')} AS type FROM findings"))(_types(_tool, lambda n, c=_codes: pick(c, n), lambda n: F.lit("odd")))

REMOVED = ("if x:", "assert x", "y = 1", "iffy = 2", "")
ADDED = ("y = cast(Any, x)", "if x and y:", "z = 1  # noqa", "def f() -> object:", "z: Any = 1  # type: ignore", "ok = 1")


@query("p31_strength", with_views("decisions", body=f"""+x AS (SELECT seq, code, {pick_sql(REMOVED, 'seq')} AS r, {pick_sql(ADDED, 'seq')} AS a, seq % 3 = 0 AS known FROM decisions),
y AS (SELECT seq, known, concat_ws(',', CASE WHEN a LIKE '%Any%' THEN 'any_type' END, CASE WHEN a LIKE '%# type: ignore%' THEN 'type_ignore_comment' END, CASE WHEN a LIKE '%cast(Any%' THEN 'cast_any' END, CASE WHEN a LIKE '%-> object%' THEN 'return_object' END, CASE WHEN a LIKE '%# noqa%' THEN 'noqa_suppress' END, CASE WHEN r IN ('if x:', 'assert x') AND a NOT LIKE 'if %' THEN 'removed_check_without_replacement' END) AS markers FROM x)
SELECT seq, CASE WHEN markers = '' THEN 'strong' ELSE 'weak' END AS strength, markers, CASE WHEN markers = '' THEN NULL WHEN known THEN 'by_design' ELSE 'concerning' END AS category FROM y"""))
def p31(spark, d):
    n = F.col("seq")
    s = rules.fix_strength(F.array(pick(REMOVED, n)), F.array(F.lit("pass"), pick(ADDED, n)), F.when(n % 3 == 0, "import-untyped").otherwise("arg-type"))
    return decisions(spark, d).select("seq", s.alias("s")).select("seq", "s.strength", F.array_join("s.weak_markers", ",").alias("markers"), F.col("s.weak_category").alias("category"))


# --- training rows ---


@query("p17_after_text", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN concat('keep ', p_name, chr(10), 'new', chr(10), chr(10), '+x') WHEN 1 THEN '' ELSE concat('a', chr(10), 'b', p_size) END AS after FROM part")
def p17(spark, d):
    one = F.concat(F.lit("diff --git a/x b/x\nindex 1..2\n--- a/x\n+++ b/x\n@@ -1,2 +1,2 @@\n\n keep "), "p_name", F.lit("\n-old\n+new\n\n++x\n"))
    two = F.concat(F.lit("@@ -1 +1 @@\r\n a\r\n--- a/y\r\n@@ -5 +5 @@\r\n+b"), "p_size")
    patch = F.when(F.col("p_partkey") % 3 == 0, one).when(F.col("p_partkey") % 3 == 1, "no patch").otherwise(two)
    return table(spark, d, "part").select("p_partkey", mining.after_text(patch).alias("after"))


@query("p18_prompts", with_views("findings", body="SELECT seq, concat('Language: ', CASE WHEN seq % 2 = 0 THEN 'python' ELSE 'code' END, chr(10), 'Finding: ', coalesce(nullif(code, ''), '?'), chr(10), 'Message: ', coalesce(message, ''), chr(10), chr(10), 'CODE:', chr(10), CASE WHEN seq % 5 > 0 THEN concat('x', chr(10), 'y') ELSE '' END, chr(10), chr(10), 'Produce the fix.') AS prompt, CASE seq % 4 WHEN 0 THEN concat('z', line) WHEN 1 THEN concat('w', line) ELSE '' END AS target FROM findings"))
def p18(spark, d):
    n = F.col("seq")
    context = F.when(n % 5 > 0, F.array(F.lit("x"), F.lit("y")))
    after = F.when(n % 4 == 0, F.array(F.concat(F.lit("z"), "line"))).when(n % 4 == 1, F.array(F.lit("  ")))
    patch = F.when(n % 4 < 2, F.concat(F.lit("--- a/f\n+++ b/f\n@@ -1 +1 @@\n-v\n+w"), "line")).when(n % 4 == 2, '{"edits": []}').otherwise("@@ -1 +1 @@\n+a/f.py")
    return findings(spark, d).select("seq", mining.prompt(F.col("code"), F.when(n % 2 == 0, "python"), F.col("message"), context).alias("prompt"), mining.target(after, patch).alias("target"))


# --- streams ---


@query("t4_breaker", """WITH e AS (SELECT concat('u', user_id) AS key, event_id, event_type = 'error' AS bad FROM events), l AS (SELECT key, max(CASE WHEN NOT bad THEN event_id ELSE -1 END) AS good FROM e GROUP BY key)
SELECT e.key, count(*) FILTER (WHERE e.event_id > l.good AND bad) AS failures, count(*) FILTER (WHERE e.event_id > l.good AND bad) >= 3 AS open FROM e JOIN l ON l.key = e.key GROUP BY e.key""")
def t4_breaker(spark, d):
    out = _drain(spark, d, lambda e: streaming.breaker(e.select(F.concat(F.lit("u"), "user_id").alias("key"), (F.col("event_type") != "error").alias("ok"), F.col("event_id").alias("seq"))), "update")
    return out.groupBy("key").agg(F.max_by("failures", "seq").alias("failures"), F.max_by("open", "seq").alias("open"))


@query("t6_rescan", "SELECT concat('u', user_id) AS file, arg_max(value, event_id) > 50 AS high FROM events GROUP BY user_id")
def t6_rescan(spark, d):
    out, at = shared_folder(spark, "rescan"), shared_folder(spark, "rescan-checkpoint")
    source = spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "events*.parquet").parquet(d)
    files = source.select(F.concat(F.lit("u"), "user_id").alias("file"), F.col("event_id").alias("seq"), "value")
    streaming.rescan(files, lambda rows: rows.select("file", (F.col("value") > 50).alias("high")), out, at).awaitTermination()
    found = spark.read.parquet(f"{out}/findings")
    return found.filter(F.col("batch") == found.agg(F.max("batch")).first()[0]).select("file", "high")
