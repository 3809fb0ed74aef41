"""Views that give the supplied tables the shapes of findings, scans, decisions, edges and source lines.

Each view is a list of expressions that Spark and DuckDB both read, so that an oracle starts from the
same rows; what an operator does with them is written independently in DataFrame code and in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

FINDING = {
    "seq": "l_orderkey * 10 + l_linenumber",
    "file": "concat('src/m', l_orderkey % 200, '/f', l_orderkey % 3, '.py')",
    "line": "CAST(l_linenumber * 5 + l_partkey % 5 AS INT)",
    "col": "CAST(l_suppkey % 80 + 1 AS INT)",
    "code": "CASE l_partkey % 12 WHEN 0 THEN 'E999' WHEN 1 THEN 'F401' WHEN 2 THEN 'E501' WHEN 3 THEN 'W503' WHEN 4 THEN 'F821' WHEN 5 THEN 'E0308' WHEN 6 THEN 'clippy::needless_return' WHEN 7 THEN '' WHEN 8 THEN 'python.lang.security.audit.exec' WHEN 9 THEN 'name-defined' WHEN 10 THEN 'CS0246' ELSE 'E302' END",
    "message": "CASE l_partkey % 8 WHEN 0 THEN concat('SyntaxError: invalid syntax (line ', l_linenumber, ')') WHEN 1 THEN concat('`os` imported but unused ', l_suppkey % 5) WHEN 2 THEN concat('line too long (', 80 + l_suppkey % 40, ' > 79 characters)') WHEN 3 THEN concat('undefined name ''sym', l_suppkey % 6, '''') WHEN 4 THEN concat('expected one of `;`, found `x', l_suppkey % 9, '`') WHEN 5 THEN concat('Mismatched types: expected `u', l_suppkey % 3, '`') WHEN 6 THEN 'unknown prefix on literal' ELSE concat('cannot find `sym', l_suppkey % 6, '` in scope') END",
    "severity": "CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'critical' WHEN '2' THEN 'error' WHEN '3' THEN 'warning' WHEN '4' THEN 'info' ELSE '' END",
    "level": "CASE WHEN l_suppkey % 7 = 0 THEN 'warning' ELSE 'error' END",
    "error_type": "CASE l_suppkey % 6 WHEN 0 THEN 'syntax' WHEN 1 THEN 'type' WHEN 2 THEN 'security' WHEN 3 THEN 'lint' WHEN 4 THEN 'CRITICAL_SYNTAX' ELSE NULL END",
    "error_class": "CASE l_suppkey % 9 WHEN 0 THEN 'SECURITY' WHEN 1 THEN 'CLEANUP' WHEN 2 THEN 'CRITICAL_SYNTAX' WHEN 3 THEN '' ELSE NULL END",
    "confidence": "l_discount * 10",
    "base_weight": "CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE l_quantity * 2 END",
    "tool": "CASE l_linenumber % 4 WHEN 0 THEN 'primary' WHEN 1 THEN 'ruff' WHEN 2 THEN 'mypy' ELSE 'semgrep' END",
    "part": "l_partkey % 10",
    "ts": "l_shipdate",
}
DECISION = {
    "seq": "event_id",
    "ts": "ts",
    "project": "concat('p', user_id % 40)",
    "file": "concat('src/d', user_id % 7, '/u', user_id, '.py')",
    "line": "CAST(event_id % 90 + 1 AS INT)",
    "code": "CASE event_id % 6 WHEN 0 THEN 'E501' WHEN 1 THEN 'F401' WHEN 2 THEN 'name-defined' WHEN 3 THEN '' WHEN 4 THEN 'E999' ELSE 'W503' END",
    "decision": "CASE event_type WHEN 'purchase' THEN 'ACCEPT' WHEN 'error' THEN 'REJECT' WHEN 'view' THEN 'NEEDS_REVIEW' WHEN 'click' THEN 'RETRY' ELSE 'FAILED' END",
    "reason": "CASE event_id % 5 WHEN 0 THEN 'target_error_still_present' WHEN 1 THEN 'error_count_not_decreased' WHEN 2 THEN 'no_effect' WHEN 3 THEN 'guard' ELSE '' END",
    "patch_source": "CASE event_id % 9 WHEN 0 THEN 'llm' WHEN 1 THEN 'memory' WHEN 2 THEN 'golden' WHEN 3 THEN 'llm_blocking_single' WHEN 4 THEN 'type_ignore' WHEN 5 THEN '' WHEN 6 THEN 'syntax_reconstruction' WHEN 7 THEN 'correctr' ELSE 'other' END",
    "review_verdict": "CASE event_id % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'wrong' WHEN 2 THEN '' ELSE 'skipped' END",
    "confidence": "CASE WHEN event_id % 11 = 0 THEN NULL ELSE value / 500 END",
    "error_count": "CAST(floor(value) AS INT) % 60",
    "symbol_regression": "event_id % 13 = 0",
    "value": "value",
    "user_id": "user_id",
}


def _select(view: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in view.items())


SQL = {
    "findings": f"SELECT {_select(FINDING)} FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "before_scan": "SELECT * FROM findings WHERE part < 6",
    "after_scan": "SELECT * FROM findings WHERE part >= 4",
    "decisions": f"SELECT {_select(DECISION)} FROM events",
    "edges": "SELECT DISTINCT concat('c', c_nationkey) AS src, concat('n', c_nationkey % 5) AS dst FROM customer UNION SELECT DISTINCT concat('n', n_nationkey % 5), concat('r', n_regionkey) FROM nation UNION SELECT DISTINCT concat('s', s_suppkey), concat('c', s_nationkey) FROM supplier UNION SELECT DISTINCT concat('r', r_regionkey), concat('r', r_regionkey - 1) FROM region WHERE r_regionkey > 0",
    "doc_lines": "SELECT doc_id, CAST(pos AS INT) AS line, txt AS text FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS txt, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)",
}


def with_views(*names: str, body: str) -> str:
    """body with the views it needs as common table expressions."""
    wanted = [n for n in names if n != "findings"]
    if {"before_scan", "after_scan", "findings"} & set(names):
        wanted.insert(0, "findings")
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in wanted) + (", " if body.lstrip().startswith("+") else " ") + body.lstrip().lstrip("+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def findings(spark: SparkSession, d: str, place: bool = False) -> DataFrame:
    """place: with ``place``, a finding's file and row there, which tells rows of one seq apart in the order of the input."""
    rows = table(spark, d, "lineitem")
    if place:
        rows = rows.select("*", F.struct("_metadata.file_path", "_metadata.row_index").alias("place"))
    joined = rows.join(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), F.expr("l_orderkey = o_orderkey"))
    return joined.selectExpr(*[f"{e} AS {n}" for n, e in FINDING.items()], *["place"] * place)


def scans(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The scans before and after, which share two tenths of the findings."""
    f = findings(spark, d)
    return f.filter("part < 6"), f.filter("part >= 4")


def decisions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").selectExpr(*[f"{e} AS {n}" for n, e in DECISION.items()])


def edges(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: table(spark, d, n)
    e = t("customer").selectExpr("concat('c', c_nationkey) AS src", "concat('n', c_nationkey % 5) AS dst")
    e = e.union(t("nation").selectExpr("concat('n', n_nationkey % 5)", "concat('r', n_regionkey)"))
    e = e.union(t("supplier").selectExpr("concat('s', s_suppkey)", "concat('c', s_nationkey)"))
    return e.union(t("region").filter("r_regionkey > 0").selectExpr("concat('r', r_regionkey)", "concat('r', r_regionkey - 1)")).distinct()


def doc_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").selectExpr("doc_id", "posexplode(split(coalesce(text, ''), '\n', -1)) AS (p, text)").selectExpr("doc_id", "p + 1 AS line", "text")
