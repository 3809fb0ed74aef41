"""Operators on hot keys, many equal rows and rows in no order: what fails only on large tables, made small."""

import random

import pandas as pd
from pyspark.sql import functions as F

from tallyloom.operators import cascade, diff, lexer, ranking, scanners, symbols
from tallyloom.plans.adapters import findings
from tallyloom.plans.comparisons import entry_query
from tallyloom.sources import sinks, tools
from tallyloom.streaming import events


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_nearest_match_of_many_equal_places_forms_no_pairs(spark, rows):
    """100,000 anchors at one place and as many lines at another: ten thousand million pairs."""
    n = 100_000
    anchors = spark.range(n).select("id", F.lit("a").alias("file"), F.lit(10).alias("line"), F.lit("t").alias("match"))
    lines = spark.range(n).select(F.lit("a").alias("file"), F.lit(12).alias("line"), F.lit("t").alias("text"))
    rows(ranking.nearest_match(anchors, lines).groupBy("found").count(), (12, n))


def test_nearest_match_equals_a_search_of_all_pairs(spark):
    rnd = random.Random(3)
    some = lambda n: [(i, rnd.choice(["a", "b", None]), rnd.choice([1, 5, 20, 40, 41, None]), rnd.choice(["s", "t", None])) for i in range(n)]
    anchors, lines = some(60) + [(0, "a", 20, "t")], some(25)
    want = []
    for i, *_ in anchors:
        hits = [(at, line) for j, file, line, match in anchors if j == i for _, f, at, t in lines if file is not None and match is not None and (f, t) == (file, match)]
        near = [(abs(at - line), at) for at, line in hits if at is not None and line is not None and abs(at - line) <= 15]
        want.append((i, min(near)[1] if near else hits[0][0] if len(hits) == 1 else None))
    schema = "id int, file string, line int, match string"
    found = ranking.nearest_match(spark.createDataFrame(anchors, schema), spark.createDataFrame(lines, schema).withColumnRenamed("match", "text"))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)


def test_cargo_audit_sends_no_exploded_side_through_the_driver(spark):
    docs = spark.range(3).select(F.col("id").alias("p"), F.lit("{}").alias("value"))
    manifest = spark.range(3).select(F.col("id").alias("p"), F.lit(1).alias("line"), F.lit("time = 1").alias("text"))
    found = tools.cargo_audit(docs, manifest, ["p"])
    assert "Broadcast" not in plan(found) and "SortMergeJoin" in plan(found)


def test_weights_of_no_keys_are_null(spark):
    got = diff.diff_summary(spark.createDataFrame([("improved", 2.0, 1.0)], "status string, before_weight double, after_weight double")).first()
    assert (got.new, got.improved, got.new_weight, got.resolved_weight, got.total_before) == (0, 1, None, None, 2.0)


def test_rows_of_a_key_are_put_in_order_across_arrow_batches():
    parts = [pd.DataFrame({"seq": [5, 1]}), pd.DataFrame({"seq": [4, 0]}), pd.DataFrame({"seq": [3, 2]})]
    assert list(events.in_order(iter(parts)).seq) == [0, 1, 2, 3, 4, 5]


def test_streams_take_rows_by_seq_across_arrow_batches(spark, tmp_path):
    n = 1000  # every other row fails, but for the last three; batches of ten rows
    made = spark.range(n).select(F.lit("k").alias("key"), F.lit("h").alias("file_hash"), F.col("id").alias("seq"), ((F.col("id") % 2 == 0) & (F.col("id") < n - 3)).alias("ok"))
    made.withColumns({"file": F.lit("f"), "reason": F.when(F.col("seq") % 3 == 0, "x").when(F.col("seq") % 3 == 1, "y").otherwise("z")}).orderBy(F.xxhash64("seq")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(size)
    spark.conf.set(size, "10")
    try:
        for name, rows_ in (("ordered_breaker", events.breaker(stream.select("key", "ok", "seq"))), ("ordered_attempts", events.attempts(stream.select("file", "file_hash", "reason", "seq")))):
            rows_.writeStream.outputMode("update").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(size, was)
    assert [tuple(r) for r in spark.table("ordered_breaker").collect()] == [("k", n - 1, 3, True)]
    assert [tuple(r) for r in spark.table("ordered_attempts").collect()] == [("f", n, 1, False)]


def test_a_frequent_category_is_written_by_all_tasks(spark, tmp_path):
    sinks.review_queue(spark.range(0, 1000, 1, 5).select("id", F.lit("a").alias("category")), str(tmp_path / "q"))
    assert len(list((tmp_path / "q" / "category=a").glob("*.parquet"))) == 5 and spark.read.parquet(str(tmp_path / "q")).count() == 1000


def test_texts_of_sources_are_not_gathered_by_one_task(spark, tmp_path):
    for i in range(5):
        (tmp_path / f"a {i}.py").write_text("x" * (i + 1))
    found = tools.read_sources(spark, str(tmp_path), (".py",), 3)
    assert [len(r.text) for r in found.orderBy("file").collect()] == [1, 2, 3]
    limit = next(line for line in plan(found).split("\n") if "TakeOrderedAndProject" in line)
    assert "text" not in limit and "value" not in limit


def test_a_cluster_has_one_root_though_its_seq_is_not_unique(spark, rows):
    df = spark.createDataFrame([(0, 7, "a", 1), (1, 7, "a", 2), (2, 8, "a", 3)], "id int, seq int, file string, line int").withColumns({"code": F.lit("x"), "message": F.lit("`q`"), "sig": F.concat(F.lit("s"), "id"), "is_root": F.lit(False), "derived_from": F.lit(None).cast("string")})
    rows(cascade.symbol_cascade(df, row="id").select("id", "is_root", "derived_from"), (0, True, None), (1, False, "s0"), (2, False, "s0"))


def test_findings_of_frequent_symbols_and_those_without_are_spread(spark, monkeypatch):
    monkeypatch.setattr(cascade, "HOT", 50)
    kind = F.when(F.col("seq") % 4 == 0, "`hot`").when(F.col("seq") % 40 == 1, "`cold`").otherwise("none")
    df = spark.range(400).select(F.col("id").alias("seq"), F.lit("f").alias("file"), F.col("id").cast("int").alias("line"), F.lit("x").alias("code"), kind.alias("message"), F.concat(F.lit("s"), "id").alias("sig"), F.lit(False).alias("is_root"), F.lit(None).cast("string").alias("derived_from"))
    out = cascade.symbol_cascade(df)
    got = {r.seq: (r.is_root, r.derived_from) for r in out.collect()}
    want = {i: (i in (0, 1), "s0" if i % 4 == 0 and i else "s1" if i % 40 == 1 and i > 1 else None) for i in range(400)}
    assert got == want
    assert plan(out).count("BroadcastExchange") >= 1
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:  # the keys of the shuffle: no one has many findings
        keys = cascade.symbol_cascade(df)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "xxhash64" in keys


def test_groups_take_one_pass(spark, rows):
    df = spark.createDataFrame([(3, "a", None), (1, "a", None), (5, "b", "a"), (4, "c", "a"), (6, "d", "gone")], "seq int, sig string, derived_from string")
    out = cascade.groups(df)
    rows(out, ("a", 1, 2, 4))
    assert "Join" not in plan(out)


def test_a_line_is_lexed_once_from_each_state(spark):
    df = spark.createDataFrame([("{ // }",), ('" }',)], "text string")
    assert [[tuple(x) for x in r[0]] for r in df.select(lexer.effect(F.col("text"))).collect()] == [[(0, 1, 0), (1, 0, 0), (2, 0, 0), (3, 0, 0)], [(2, 0, 0), (1, 0, 0), (0, 0, 1), (3, 0, 0)]]
    # four states: a search for what hides braces in each, and one for the end of three
    assert df.select(lexer.effect(F.col("text")).alias("e"))._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 7


def test_unused_imports_of_a_long_text(spark):
    """20,000 names, each imported once and used by every other: a search for each in the whole text would read 10,000 million letters."""
    n = 20_000
    text = "\n".join(f"import pkg.name{i}" for i in range(n)) + "\n" + "\n".join(f"name{i}()" for i in range(0, n, 2)) + "\nimport a\nimport a\nuse x:y"
    r = scanners.authorship(spark.createDataFrame([(text,)], "text string")).first()
    assert abs(r.unused_imports - (n / 2 + 1) / (n + 3)) < 1e-12


def test_segments_of_a_long_file(spark):
    """Of 600,000 lines every third opens a block; the segments so far were copied at each of them before."""
    lines = spark.range(1, 600_001).select(F.lit("f").alias("file"), F.col("id").alias("line"), F.when(F.col("id") % 3 == 0, "def x():").otherwise(" y").alias("text"))
    got = scanners.segments(lines, 40).agg(F.count("*").alias("n"), F.min("start").alias("a"), F.max("end").alias("b"), F.sum(F.expr("end - start + 1")).alias("all"), F.max(F.expr("end - start + 1")).alias("most")).first()
    assert (got.a, got.b, got["all"]) == (1, 600_000, 600_000) and got.most <= 40


def test_findings_are_not_sent_to_all_tasks_for_related_definitions(spark):
    asked = spark.range(3).select("id", F.lit("g").alias("file"), F.lit("`helper` fails").alias("message"))
    index = spark.createDataFrame([("f", 1, "helper"), ("g", 2, "helper")], "file string, line int, name string")
    lines = spark.createDataFrame([("f", 1, "def helper():"), ("f", 2, "  pass"), ("g", 2, "x")], "file string, line int, text string")
    out = symbols.related_definitions(asked, index, lines)
    assert sorted(map(tuple, out.collect())) == [(i, 1, "helper", "f", 1, False, "def helper():\n  pass") for i in range(3)]
    assert "BuildLeft" not in plan(out)


def test_findings_of_one_seq_are_told_apart_by_their_place(spark, tmp_path):
    line = lambda supplier: (1, 3, supplier, 1, 1.0, 1.0, 0.0)
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double"
    spark.createDataFrame([line(6 * k) for k in (8, 7, 1)], schema).withColumn("l_shipdate", F.lit("2024-01-01").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(1, "1-URGENT")], "o_orderkey long, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    rows = findings(spark, str(tmp_path), place=True)
    assert rows.select("seq").distinct().count() == 1
    assert [r.col for r in rows.orderBy("place").collect()] == [49, 43, 7]
    assert entry_query(spark, str(tmp_path)).first().n == 1
