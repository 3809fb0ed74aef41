"""Boundary cases of the operators on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import rules, text
from tallyloom.operators import cascade, dedup, diff, graph, mining, ranking, scanners, stats, streaks
from tallyloom.sources import sinks, tools
from tallyloom.streaming import events as streaming

FINDING = "seq long, file string, line int, code string, message string, error_class string, error_type string, severity string"


def finding(spark, *rows):
    full = [(i, *r, *[None] * (7 - len(r))) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, FINDING)


def test_normalize_message(spark, rows):
    df = spark.createDataFrame([("SyntaxError: invalid  syntax (line 12)",), (None,), ("Ünïcode Ä1!",), ("12",)], "m string")
    rows(df.select(text.normalize_message(F.col("m"))), ("invalid syntax line",), ("",), ("ünïcode ä",), ("",))


def test_split_lines(spark, rows):
    df = spark.createDataFrame([("a\r\nb\n",), ("",), (None,), ("a\n\nb",), ("a\u2028b",)], "t string")
    rows(df.select(F.size(text.split_lines(F.col("t")))), (2,), (0,), (0,), (3,), (2,))


def test_signature(spark, rows):
    df = finding(spark, ("a.py", 1, "E1", "x 1"), ("a.py", 1, "", "x 2"), (None, None, None, None))
    rows(df.select(text.signature(F.col("file"), F.col("code"), F.col("message"))), ("a.py::E1::x",), ("a.py::x",), ("::",))


def test_symbols(spark, rows):
    df = spark.createDataFrame([("'b' and `a` and `a` and 'c'",), (None,)], "m string")
    rows(df.select(F.array_join(text.symbols(F.col("m")), ",")), ("a,b,c",), ("",))


@pytest.mark.parametrize("file,code,level,message,expected", [("x/build.rs", "", "", "", "BUILD_SCRIPT"), ("Cargo.toml", "", "warning", "", "MANIFEST"), ("a", "", "Warning", "", "CLEANUP"), ("a", "", "", "variable never used", "CLEANUP"), ("a", "clippy::x", "", "", "CLEANUP"), ("a", "", "", "unknown prefix", "CRITICAL_SYNTAX"), ("a", "", "", "expected ';'", "CRITICAL_SYNTAX"), ("a", "py.security.x", "", "", "SECURITY"), ("a", "E1", "", "x", "UNKNOWN"), (None, None, None, None, "UNKNOWN")])
def test_classify(spark, file, code, level, message, expected):
    df = spark.createDataFrame([(file, code, level, message)], "f string, c string, l string, m string")
    assert df.select(rules.classify(F.col("f"), F.col("c"), F.col("l"), F.col("m"))).first()[0] == expected


def test_source_confidence(spark, rows):
    df = spark.createDataFrame([("golden",), ("llm_blocking_x",), (" ",), (None,), ("zzz",)], "s string")
    rows(df.select(rules.source_confidence(F.col("s"))), (0.95,), (0.6,), (0.5,), (0.5,), (0.5,))


def test_dedup_is_first_wins_whatever_the_partitions(spark):
    df = finding(spark, ("a", 1, "x", "m"), ("a", 1, "y", "m"), (None, None, "z", None), ("", 0, "q", ""))
    for n in (1, 2, 7):
        got = dedup.dedup_findings(df.repartition(n), ["seq"]).select("seq").collect()
        assert sorted(r.seq for r in got) == [0, 2]


def test_append_new_treats_nulls_as_equal(spark, rows):
    new = finding(spark, ("a", 1, None), ("a", 2, None), ("b", 1, "x"), ("b", 1, "x"))
    old = finding(spark, ("a", 1, None))
    rows(dedup.append_new(new, old, ["file", "line", "code"], ["seq"]).select("seq"), (1,), (2,))


def test_new_findings_normalises_paths(spark, rows):
    before, after = finding(spark, ("a\\b.py", 1, "E")), finding(spark, ("/a/b.py", 1, "E"), ("a/b.py", 2, "E"))
    rows(diff.new_findings(before, after).select("seq"), (1,))


def test_diff_of_a_scan_with_itself_is_unchanged(spark):
    df = finding(spark, ("a", 1, "E"), ("a", 2, "E"), ("b", 1, "F")).withColumn("w", F.lit(2.0))
    assert {r.status for r in diff.weighted_diff(df, df, "code", "w").collect()} == {"unchanged"}
    assert dedup.compare_sets(df, df, ["file"]).filter("side <> 'common'").isEmpty()


@pytest.mark.parametrize("line,masking,original,expected", [(20, False, "E1", "regression"), (21, False, "E1", "uncertain"), (20, True, "E1", "uncertain"), (21, True, "E1", "unmasked")])
def test_growth_by_distance(spark, line, masking, original, expected):
    new = spark.createDataFrame([("p", "a.py", line, "N", 0, 1)], "patch string, file string, line int, code string, count_before int, count_after int")
    patch = spark.createDataFrame([("p", "a.py", "BLOCKING", original, masking, [10])], "patch string, patched_file string, original_class string, original_code string, masking boolean, changed_lines array<int>")
    assert diff.classify_growth(new, patch).first().bucket == expected


def test_growth_of_other_files_and_siblings(spark, rows):
    new = spark.createDataFrame([("p", "b.py", 1, "N", 0, 1), ("p", "a.py", 1, "W504", 0, 1), ("p", "a.py", 1, "E9", 2, 2)], "patch string, file string, line int, code string, count_before int, count_after int")
    patch = spark.createDataFrame([("p", "a.py", "STYLE", "W503", False, [1])], "patch string, patched_file string, original_class string, original_code string, masking boolean, changed_lines array<int>")
    rows(diff.growth_decision(diff.classify_growth(new, patch)).select("regression", "uncertain", "decision"), (0, 1, "needs_review"))


def test_has_fresh_at_the_tolerance(spark, rows):
    records = finding(spark, ("a", 10, "E"), ("a", 20, "E"), ("a", 10, "F"))
    fresh = finding(spark, ("a", 15, "E"), ("b", 20, "E"))
    rows(diff.has_fresh(records, fresh).select("seq"), (0,), (1,))
    rows(diff.has_fresh(records, finding(spark, ("a", 16, "E"))).select("seq"), (1,))


def test_segments_fall_back_to_the_whole_file(spark, rows):
    lines = spark.createDataFrame([("a", 5), ("b", 5)], "file string, line int")
    segments = spark.createDataFrame([("a", 1, 5), ("a", 6, 9), ("b", 6, 9)], "file string, start int, end int")
    rows(diff.in_segments(lines, segments), ("a", 1, 5), ("b", 1, 0))


def test_thresholds(spark):
    df = spark.createDataFrame([([0.1, 0.2, 0.3, 0.4, 0.5],), ([0.9],), (None,)], "s array<double>")
    a, r = diff.thresholds(F.col("s"), F.lit(0), F.lit(0))
    got = [tuple(round(x, 6) for x in row) for row in df.select(a, r).collect()]
    assert got[0] == (0.4, -0.36) and got[1] == (0.3, -0.3)


def test_streak_and_reset(spark, rows):
    df = spark.createDataFrame([(i, "f", r) for i, r in enumerate("aabba")], "seq int, file string, reason string")
    rows(streaks.streak(df, ["file"], ["seq"], F.col("reason")).select("seq", "streak"), (0, 1), (1, 2), (2, 1), (3, 2), (4, 1))
    rows(streaks.count_since(df, ["file"], ["seq"], F.col("reason") == "a", F.col("reason") == "b", "k").select("seq", "k"), (0, 1), (1, 2), (2, 0), (3, 0), (4, 1))


@pytest.mark.parametrize("counts,expected", [([10, 12], None), ([10, 13], "global_invariant"), ([5, 0], "completed")])
def test_stop_reason_at_the_growth_limit(spark, counts, expected):
    df = spark.createDataFrame([(i, "p", c, 1, 0, 10) for i, c in enumerate(counts)], "seq int, project string, n int, acc int, rej int, ini int")
    out = streaks.stop_reason(df, ["project"], ["seq"], count="n", initial=F.col("ini"), accepted="acc", rejected="rej")
    assert out.orderBy("seq").collect()[-1].stop_reason == expected


def test_quarantine_depth(spark, rows):
    files = [f"top/a/f{i}.py" for i in range(3)] + [f"top/b/f{i}.py" for i in range(2)]
    df = spark.createDataFrame([(f,) for f in files], "file string")
    rows(streaks.quarantined(df), ("top/a", 3))


def test_cascade(spark):
    df = finding(spark, ("a", 5, "E999", "bad", "CRITICAL_SYNTAX"), ("a", 5, "X", "same line"), ("a", 4, "X", "above"), ("b", 1, "F821", "undefined name 'foo'"), ("b", 2, "X", "foo is odd"), ("b", 0, "X", "foo before"), ("c", 1, "X", "`q` 1"), ("d", 1, "X", "`q` 2"), ("e", 1, "X", "`q` 3"))
    got = {r.seq: (r.is_root, r.derived) for r in cascade.collapse(df).collect()}
    assert got == {0: (True, False), 1: (False, True), 2: (False, False), 3: (True, False), 4: (False, True), 5: (False, False), 6: (True, False), 7: (False, True), 8: (False, True)}


def test_cascade_of_an_empty_table(spark):
    assert cascade.collapse(finding(spark)).count() == 0


def test_root_cause_prefers_the_highest_priority(spark):
    df = finding(spark, ("a", 1, "x"), ("b", 2, "y"), ("b", 9, "z")).withColumn("priority", F.when(F.col("file") == "b", 5.0).otherwise(4.0))
    none = spark.createDataFrame([], "file string, cascade double")
    assert ranking.root_cause(df, none).first().seq == 2


def test_unprotected_falls_back_to_all(spark):
    assert ranking.unprotected(finding(spark, ("config/a", 1), ("b", 1))).count() == 1
    assert ranking.unprotected(finding(spark, ("config/a", 1), ("Cargo.toml", 1))).count() == 2


def test_reach_ends_on_cycles(spark, rows):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], "src string, dst string")
    start = spark.createDataFrame([("a",)], "node string")
    rows(graph.chain_score(edges, start), ("a", 4))
    rows(graph.impact(edges, start).select("radius", "depth"), (2, 2))


def test_security_rules(spark):
    lines = ['password = "hunter2"', 'password = "x"', "obj.eval(x)", "eval(x)", "# eval(x)", 'k = os.getenv("password")']
    df = spark.createDataFrame([("f", i, t) for i, t in enumerate(lines)], "file string, line int, text string")
    assert {(r.line, r.code) for r in scanners.security_scan(df, "python").collect()} == {(0, "hardcoded_secret"), (3, "dangerous_eval")}


def test_changed_lines(spark):
    patch = "--- a/f\n+++ b/f\n@@ -1,3 +1,4 @@\n a\n+b\n+c\n d\n-e\n f\n@@ -20,1 +30,1 @@\n-x\n+y"
    df = spark.createDataFrame([(patch,), (None,), ("",)], "p string")
    assert [r[0] for r in df.select(scanners.changed_lines(F.col("p"))).collect()] == [[2, 3, 5, 30], [], []]


def test_lost_symbols(spark):
    df = spark.createDataFrame([("def a():\n  pass\nclass B:\n", "class B:\n"), ("", "def x(): 1"), (None, None)], "b string, a string")
    assert [r.lost for r in scanners.lost_symbols(df, "b", "a", "python").collect()] == [["a"], [], []]


def test_renames(spark, rows):
    df = spark.createDataFrame([(1, ["data", "Name", "old"], ["date", "name", "new"])], "id int, r array<string>, a array<string>")
    rows(mining.renames(df, ["id"], "r", "a").select("old", "new", "kind"), ("data", "date", "near_rename"), ("Name", "name", "case_rename"), ("Name", "date", "near_rename"))


def test_stats_of_nothing(spark):
    out = stats.error_stats(finding(spark).withColumn("w", F.lit(1.0)), "w").collect()
    assert [(r.kind, r.n) for r in out] == [("all", 0)]


def test_counts_stay_null_when_unknown(spark):
    df = spark.createDataFrame([("p", "RETRY", False, None)], "project string, decision string, symbol_regression boolean, confidence double")
    row = stats.run_summary(df, ["project"]).first()
    assert row.mean_confidence is None and row.accept_share is None


def test_text_sources(spark, rows):
    df = spark.createDataFrame([("a.py:3:7: E501 too long",), ("nonsense",), ("a.py:4:1: W1 odd",)], "value string")
    rows(tools.parse_text(df, "flake8").select("file", "line", "col", "code", "severity"), ("a.py", 3, 7, "E501", "error"), ("a.py", 4, 1, "W1", "warning"))


def test_json_source_skips_broken_documents(spark):
    good = json.dumps({"results": [{"filename": "a", "line_number": 3, "test_id": "B1", "issue_text": "t", "issue_severity": "LOW"}]})
    df = spark.createDataFrame([(good,), ("{",), (None,)], "value string")
    assert [(r.file, r.line, r.severity) for r in tools.parse_json(df, "bandit").collect()] == [("a", 3, "low")]


def test_python_syntax(spark):
    df = spark.createDataFrame([("a", "def f(:\n"), ("b", "x = 1"), ("c", None)], "file string, text string")
    assert [(r.file, r.line) for r in tools.python_syntax(df).collect()] == [("a", 1)]


def test_jsonl_round_trip(spark, tmp_path):
    path = str(tmp_path / "log")
    sinks.append_jsonl(spark.createDataFrame([(1, "a")], "n int, t string"), path)
    sinks.append_jsonl(spark.createDataFrame([(2, "b")], "n int, t string"), path)
    assert tools.read_jsonl(spark, path, "n int, t string").count() == 2


def test_redact(spark):
    df = spark.createDataFrame([({"api_key": "x", "path": "y"},)], "m map<string,string>")
    assert df.select(sinks.redact(F.col("m"))).first()[0] == {"api_key": "<redacted>", "path": "y"}


def test_review_queue(spark, tmp_path):
    path = str(tmp_path / "queue")
    sinks.review_queue(spark.createDataFrame([("a", 1), ("b", 2)], "category string, n int"), path)
    assert spark.read.parquet(path).filter("category = 'a'").count() == 1


def test_streamed_attempts_equal_the_batch(spark, tmp_path):
    rows_ = [("f", "h", r, i) for i, r in enumerate(["x", "x", "y", "x", "x", "x"])] + [("g", "h", "x", 0), ("g", "h2", "x", 1), ("g", "h2", "x", 2)]
    schema = "file string, file_hash string, reason string, seq long"
    spark.createDataFrame(rows_, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = streaming.attempts(stream).writeStream.outputMode("update").format("memory").queryName("attempts_test").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.file, r.attempts, r.blocked) for r in spark.table("attempts_test").collect()} == {("f", 6, True), ("g", 2, False)}


def test_parsers_give_nothing_for_broken_texts(spark):
    from tallyloom.operators import code

    df = spark.createDataFrame([("a", "def f(:"), ("b", None)], "file string, text string")
    for f in (code.functions_of, code.docstrings, code.macros, code.code_in_comments):
        assert f(df).count() == 0
    assert [r.parsed for r in code.literal_counts(df).collect()] == [False, True]


def test_logic_changes(spark, rows):
    from tallyloom.operators import code

    one = lambda t: code.functions_of(spark.createDataFrame([("a", t)], "file string, text string"))
    rows(code.logic_changes(one("def f(a, b=1):\n  return a"), one("def f(a, c):\n  eval(a)")).select("type", "severity"), ("REQUIRED_PARAM_ADDED", "high"), ("PARAM_REMOVED", "high"), ("RETURN_PATH_LOST", "high"), ("CALL_ADDED", "medium"), ("SIDE_EFFECT_ADDED", "high"))


@pytest.mark.parametrize("steps,expected", [([10, 11, 12], "error_growth"), ([10, 10, 10], "plateau"), ([10, 9, 8], "reject_spike")])
def test_stop_reasons_in_order(spark, steps, expected):
    df = spark.createDataFrame([(i, "p", c, 0, 2, 10) for i, c in enumerate(steps)], "seq int, project string, n int, acc int, rej int, ini int")
    out = streaks.stop_reason(df, ["project"], ["seq"], count="n", initial=F.col("ini"), accepted="acc", rejected="rej", max_cycles=9)
    assert out.orderBy("seq").collect()[-1].stop_reason == expected


def test_governor_waits_for_a_move(spark):
    from tallyloom.operators import control

    cols = "p string, seq int, stability double, success_rate double, entropy double, memory_rate double, rollback_rate double, trend double, overall double"
    df = spark.createDataFrame([("p", i, 0.0, 0.0, 1.0, 0.0, 1.0, -1.0, o) for i, o in enumerate([0.5, 0.52, 0.9])], cols)
    out = control.govern(df, "p", "seq").orderBy("seq").collect()
    assert out[1].accept_threshold == control.GOVERNED["accept_threshold"] < out[2].accept_threshold
    assert out[2].rollback_limit == 2.0


def test_run_dump(spark, tmp_path):
    df = spark.createDataFrame([(3, None)], "accepted int, delta int")
    text = sinks.run_dump(df, str(tmp_path), "Run")
    sinks.run_dump(df, str(tmp_path), "Run")
    assert "| accepted | 3 |" in text and "| delta | unknown |" in text
    assert spark.read.json(str(tmp_path / "run")).count() == 1 and spark.read.json(str(tmp_path / "runs")).count() == 2


def test_read_sources_skips_folders(spark, tmp_path):
    for name in ("a/x.py", "a/y.txt", "node_modules/z.py"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("import os\n")
    rows_ = tools.read_sources(spark, str(tmp_path), (".py", ".js")).collect()
    assert [r.file.rsplit("/", 2)[1:] for r in rows_] == [["a", "x.py"]] and rows_[0].text.strip() == "import os"


def test_project_tree(spark, rows):
    df = spark.createDataFrame([("a/b/x.py",), ("a/y.py",), ("z.py",)], "file string")
    rows(tools.project_tree(df).select("path", "kind", "depth", "truncated"), ("a", "folder", 0, False), ("a/b", "folder", 1, False), ("a/b/x.py", "file", 2, False), ("a/y.py", "file", 1, False), ("z.py", "file", 0, False))
    assert tools.project_tree(df, 2).filter("kind = 'folder' AND truncated").count() == 2


def test_segments_cover_files_and_keep_blocks(spark):
    import random

    from tallyloom.operators import scanners

    rnd, rows, opens = random.Random(2), [], {}
    for f in range(12):
        n = rnd.randint(1, 130)
        opens[f"f{f}"] = [i for i in range(1, n + 1) if rnd.random() < (0.1 if f % 3 else 0.01)]
        rows += [(f"f{f}", i, "def x():" if i in opens[f"f{f}"] else "    y = 1") for i in range(1, n + 1)]
    df = spark.createDataFrame(rows, "file string, line long, text string")
    got = {}
    for r in scanners.segments(df, 20).orderBy("file", "segment").collect():
        got.setdefault(r.file, []).append((r.start, r.end))
    for f, parts in got.items():
        n = max(i for g, i, _ in rows if g == f)
        assert parts[0][0] == 1 and parts[-1][1] == n and all(a[1] + 1 == b[0] for a, b in zip(parts, parts[1:]))
        assert all(1 <= e - s + 1 <= 20 for s, e in parts)
        for (_, e), (s, _) in zip(parts, parts[1:]):  # a cut is at the opening of a block, if any is within reach
            start = next(p for p in parts if p[1] == e)[0]
            assert s in opens[f] or not [o for o in opens[f] if start < o <= start + 20] or s - start == 20
    assert len(got) == 12 and scanners.segments(df.limit(0), 20).count() == 0


@pytest.mark.parametrize("line,family,codes", [
    ("x.password = 'abcdef'", "python", {"hardcoded_secret"}), ("x.password: str = 'abcdef'", "python", set()), ('token = "a" + os.environ["X"]', "python", set()), ("éeval(x)", "python", set()), ('Command::new("powershell")', "rust", {"command_injection"}),
    ('query("x WHERE id = " + &id)', "rust", {"sql_injection"}), ('query(AssertSqlSafe(format!("SELECT {}", x)))', "rust", set()), ("a.innerHTML == b", "js", set()), ("strncpy(a); strcpy(b)", "cpp", set()), ('cur.execute("drop table t" + x)', "python", set()), (None, "python", set()),
])
def test_security_rules(spark, line, family, codes):
    from tallyloom.operators import scanners

    df = spark.createDataFrame([("f", 1, line)], "file string, line int, text string")
    assert {r.code for r in scanners.security_scan(df, family).collect()} == codes


def test_authorship_features(spark):
    from tallyloom.operators import scanners

    text = "import os\nimport json\nfrom a.b import c\nuse crate::Player;\nprint(json)\ndef snake_case(): pass\ndef camelCase(): pass\n# TODO\n"
    r = scanners.authorship(spark.createDataFrame([(text,), (" \n",), (None,)], "text string")).collect()
    assert (r[0].unused_imports, r[0].mixed_style, r[0].placeholders) == (0.75, 0.3, 1.0)
    assert abs(r[0].score - (0.3 + 0.15 * 0.75 + 0.2 * 0.3)) < 1e-9 and r[1].score == r[2].score == 0


def test_versions(spark, rows):
    from tallyloom.operators import scanners

    f = spark.createDataFrame([("a", "E999", None), ("a", "W1", None), ("b", "E999", None), ("c", "x", "syntax")], "file string, code string, error_type string")
    texts = spark.createDataFrame([("a", "type X = int"), ("b", "x = 1"), ("c", "try:\n    pass\nexcept* E:\n    pass")], "file string, text string")
    rows(scanners.split_by_version(f, texts, 310), ("a", "E999", None, 312), ("a", "W1", None, None), ("b", "E999", None, None), ("c", "x", "syntax", 311))
    assert scanners.split_by_version(f, texts, 310, 313).filter("needs = 313").count() == 3
    assert scanners.split_by_version(f, texts, 312).filter("needs IS NOT NULL").count() == 0


def test_impact_of_critical_files(spark):
    edges = spark.createDataFrame([("a", "src/config/x.py"), ("b", "a"), ("c", "z.py")], "src string, dst string")
    start = spark.createDataFrame([("src/config/x.py", 60), ("z.py", 60), ("a", 10)], "node string, lines int")
    got = {r.node: r.criticality for r in graph.impact(edges, start, F.col("lines")).collect()}
    assert got == {"src/config/x.py": 0.75, "z.py": 0.0, "a": 0.0}


def test_reach_of_long_chains(spark):
    edges = spark.createDataFrame([(f"n{i + 1}", f"n{i}") for i in range(8)], "src string, dst string")
    start = spark.createDataFrame([("n0",)], "node string")
    assert graph.reach(edges, start).agg(F.max("depth")).first()[0] == 8
    with pytest.raises(RuntimeError):
        graph.reach(edges, start, most_steps=5)


def test_run_kpis_without_decisions_or_scans(spark):
    from tallyloom.operators import stats

    runs = spark.createDataFrame([("p", 0, 3, None, 2, 1.26)], "project string, initial_errors int, final_errors int, scan_before int, scan_after int, duration_seconds double")
    none = spark.createDataFrame([], "project string, decision string, patch_source string, review_verdict string, file string, symbol_regression boolean")
    r = stats.run_kpis(runs, none, ["project"]).first()
    assert (r.fixed, r.fixed_percent, r.scan_delta, r.duration_seconds, r.decisions, r.by_outcome) == (-3, 0.0, None, 1.3, 0, "")


def test_texts_too_complex_for_the_parser(spark):
    from tallyloom.operators import code

    df = spark.createDataFrame([("f", "(" * 5000 + "x"), ("g", "a." * 40000 + "b"), ("h", None), ("i", "not " * 30000 + "x")], "file string, text string")
    assert tools.python_syntax(df).filter("file = 'f'").count() == 1
    for scan in (code.functions_of, code.docstrings, code.code_in_comments, code.literal_counts):
        scan(df).collect()
