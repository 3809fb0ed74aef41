"""Packages, edges, symbols, tool formats, training rows and keyed streams on small tables."""

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import rules
from tallyloom.operators import code, mining, packages, symbols
from tallyloom.sources import tools
from tallyloom.streaming import events


def test_crates_of_projects_stay_apart(spark, rows):
    lines = spark.createDataFrame([("a", "src/main.rs", "use serde::Serialize;"), ("a", "src/main.rs", "use tokio::fs; // use rand::x"), ("b", "src/serde.rs", "serde::load()"), ("b", "src/x.rs", "#[derive(Parser, Error)]"), ("b", "src/x.rs", None)], "p string, file string, text string")
    listed = packages.rust_manifest(spark.createDataFrame([("a", 1, "[dependencies]"), ("a", 2, "tokio = \"1\""), ("b", 1, "[lib]"), ("b", 2, "clap = \"4\"")], "p string, line int, text string"), ["p"])
    rows(packages.missing_crates(packages.rust_names(lines, ["p"]), listed, ["p"]), ("a", "serde", "1", ""), ("b", "clap", "4", "derive"), ("b", "thiserror", "1", ""))


def test_unknown_crates_have_no_version(spark, rows):
    lines = spark.createDataFrame([("m.rs", "use odd_thing::X;")], "file string, text string")
    none = spark.createDataFrame([], "name string")
    rows(packages.missing_crates(packages.rust_names(lines), none), ("odd_thing", None, None))
    rows(packages.missing_crates(packages.rust_names(lines.filter("false")), none))


def test_longest_prefix_wins(spark, rows):
    names = spark.createDataFrame([("A.B.C",), ("A.X",), ("Q",), (None,)], "name string")
    table = spark.createDataFrame([("A", "base"), ("A.B", "special")], "prefix string, package string")
    rows(packages.missing_by_prefix(names, spark.createDataFrame([("BASE",)], "name string"), table), ("special", "A.B.C"))


def test_edges_take_the_first_file_there_is(spark, rows):
    files = spark.createDataFrame([("lib.rs", "mod a;\nmod b;\nmod c;"), ("a.rs", ""), ("a/mod.rs", ""), ("b/mod.rs", None)], "file string, text string")
    rows(code.rust_edges(files), ("lib.rs", "a.rs"), ("lib.rs", "b/mod.rs"))
    files = spark.createDataFrame([("x/a.ts", "import q from '../y';\nrequire('./b.js')\nimport z from './../../out';"), ("y/index.ts", ""), ("y.js", ""), ("x/b.js", ""), ("a.css", "require('./y')")], "file string, text string")
    rows(code.js_edges(files), ("x/a.ts", "y.js"), ("x/a.ts", "x/b.js"))


@pytest.mark.parametrize("path,plain", [("a/./b//c", "a/b/c"), ("a/../b", "b"), ("../a", None), ("a/../../b", None), ("", "")])
def test_plain_path(spark, path, plain):
    assert spark.range(1).select(code.plain_path(F.lit(path))).first()[0] == plain


def test_docs_of_rust_and_js_are_cut(spark):
    body = "\n".join(f"  let x{i} = {i};" for i in range(70))
    df = spark.createDataFrame([("f", f"/// A\nfn long() {{\n{body}\n}}"), ("g", "/// end of file"), ("h", None)], "file string, text string")
    (got,) = code.docstrings(df, "rust").collect()
    assert got.code.endswith("// ... [12 more lines truncated]") and got.line == 2 and len(got.code.split("\n")) == 61
    assert code.docstrings(spark.createDataFrame([("f", "/** open"), ("g", "/** a */")], "file string, text string"), "js").count() == 0


def test_lost_symbols_of_python(spark, rows):
    before = spark.createDataFrame([("a", "import os, sys as s\nfrom x import y\n@overload\ndef f(): ...\n@typing.overload\ndef f(x): ...\ndef f(*a): ...\nclass C: pass"), ("b", "def g(:\n  import q\n@overload\n"), ("c", ""), ("d", "def only(): pass")], "file string, text string")
    after = spark.createDataFrame([("a", "import os\n@overload\ndef f(): ...\ndef f(*a): ..."), ("b", "x = 1"), ("c", "x")], "file string, text string")
    expected = [("a", "import", "s", 1), ("a", "import", "y", 1), ("a", "overload", "f", 1), ("a", "class", "C", 1), ("b", "definition", "g", 1), ("b", "import", "q", 1), ("b", "overloads", "", 1), ("d", "definition", "only", 1)]
    expected.remove(("b", "definition", "g", 1))  # "def g(" is there
    rows(symbols.lost(before, after.union(spark.createDataFrame([("b", "def g(): pass")], "file string, text string")).filter("text <> 'x = 1'"), "python"), *expected)


def test_related_definitions(spark):
    lines = spark.createDataFrame([("a", 1, "def load(x):"), ("a", 2, "  return {"), ("a", 3, "  }"), ("a", 4, "more"), ("b", 7, "def load(y):"), ("c", 1, "class Only:")], "file string, line int, text string")
    asked = spark.createDataFrame([(1, "a", "`load` and Only"), (2, "c", "'Only' is odd"), (3, "b", "load"), (4, "x", None)], "id int, file string, message string")
    got = {(r.id, r.name): (r.place, r.file, r.line, r.same_file, r.snippet) for r in symbols.related_definitions(asked, code.symbol_index(lines, "python"), lines).collect()}
    assert got == {(1, "load"): (1, "b", 7, False, "def load(y):"), (1, "Only"): (2, "c", 1, False, "class Only:"), (2, "Only"): (1, "c", 1, True, "class Only:")}


def test_findings_of_broken_documents(spark):
    bad = spark.createDataFrame([("<results><err",), (None,), ("",), ("{",)], "value string")
    assert tools.cppcheck_findings(bad).count() == 0 and tools.verify_records(bad).count() == 0
    manifest = spark.createDataFrame([], "p int, line int, text string")
    assert tools.cargo_audit(bad.withColumn("p", F.lit(1)), manifest, ["p"]).count() == 0


@pytest.mark.parametrize("patch,after", [(None, ""), ("", ""), ("no hunk\n+x", ""), ("@@ -1 +1 @@\n a\n-b\n+c\n\\ No newline", "a\nc\n\\ No newline"), ("--- a/x\n+++ b/x\n@@ x @@\n+a\r\n+b\r+c\n\n", "a\nb\nc")])
def test_after_text(spark, patch, after):
    assert spark.range(1).select(mining.after_text(F.lit(patch).cast("string"))).first()[0] == after


def test_fix_strength(spark):
    lines = lambda *x: F.array(*[F.lit(v) for v in x])
    df = spark.range(1).select(rules.fix_strength(lines("  assert x"), lines("y"), F.lit(None).cast("string")).alias("a"), rules.fix_strength(lines("if x"), lines("if y"), F.lit("z")).alias("b"))
    a, b = df.first()
    assert (a.strength, a.weak_markers, a.weak_category) == ("weak", ["removed_check_without_replacement"], "concerning") and (b.strength, b.weak_category) == ("strong", None)


def _stream(spark, path, batches, schema):
    for n, part in enumerate(batches):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{path}/in{n}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in*")


def test_rescan_equals_a_full_scan(spark, tmp_path):
    parts = [[("a", 1, "x"), ("b", 2, "y")], [("a", 3, "z")], [("c", 4, "w"), ("c", 5, "v")], [("b", 6, "u")], [("a", 7, "t")]]
    source = _stream(spark, str(tmp_path), parts, "file string, seq long, text string")
    scanned = []

    def scan(rows):
        scanned.append(rows.count())
        return rows.select("file", F.col("text").alias("found"))

    events.rescan(source, scan, str(tmp_path / "out"), str(tmp_path / "check"), every=3).awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out/findings")).filter("batch = 4")
    seen = {r.file: r.found for r in found.collect()}
    assert seen == {"a": "t", "b": "u", "c": "v"}
    assert scanned == [2, 1, 1, 3, 1]  # all files in batches 0 and 3, the changed ones in the others


def test_breaker_counts_failures_in_a_row(spark, tmp_path):
    parts = [[("a", False, 1), ("a", False, 2)], [("a", False, 3)], [("b", False, 4), ("b", True, 5), ("b", False, 6)]]
    source = _stream(spark, str(tmp_path), parts, "key string, ok boolean, seq long")
    name = "breaker_rows"
    events.breaker(source).writeStream.outputMode("update").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    last = {r.key: (r.failures, r.open) for r in spark.table(name).groupBy("key").agg(F.max_by("failures", "seq").alias("failures"), F.max_by("open", "seq").alias("open")).collect()}
    assert last["b"] == (1, False) and last["a"] == (3, True)
