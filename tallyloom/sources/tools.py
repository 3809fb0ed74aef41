"""Readers of analyzer outputs: text lines and JSON documents become findings ``file, line, col, code, message, severity, tool``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Line formats with named places: tool -> (pattern, group of file, line, column, code, message); 0: not there.
TEXT = {
    "flake8": (r"^(.+?):(\d+):(\d+):\s*([A-Z]+\d+)\s+(.*)$", 1, 2, 3, 4, 5),
    "mypy": (r"^(.+?):(\d+)(?::(\d+))?: (?:error|warning): (.*?)(?:\s+\[([a-z-]+)\])?$", 1, 2, 3, 5, 4),
    "gcc": (r"^(.+?):(\d+):(\d+): (?:fatal )?(?:error|warning): (.*?)(?: \[(-W[\w-]+)\])?$", 1, 2, 3, 5, 4),
    "dotnet": (r"^(.+?)\((\d+),(\d+)\): (?:error|warning) ([A-Z]+\d+): (.*?)(?: \[.*\])?$", 1, 2, 3, 4, 5),
    "tsc": (r"^(.+?)\((\d+),(\d+)\): (?:error|warning) (TS\d+): (.*)$", 1, 2, 3, 4, 5),
    "javac": (r"^(.+?\.java):(\d+): (?:error|warning): (.*)$", 1, 2, 0, 0, 3),
    "go": (r"^(.+?\.go):(\d+):(\d+): (.*)$", 1, 2, 3, 0, 4),
    "kotlin": (r"^(?:e|w): (?:file://)?(.+?\.kts?):(\d+):(\d+):? (.*)$", 1, 2, 3, 0, 4),
    "rustc": (r"^\s*--> (.+?):(\d+):(\d+)()$", 1, 2, 3, 0, 4),
    "clang_tidy": (r"^\s*(.+?):(\d+):(\d+):\s+(?:error|warning):\s+(.+?)\s*\[([\w\-.]+)[\w\-.,\s]*\]\s*$", 1, 2, 3, 5, 4),
}
# cppcheck's identifiers of style and configuration, and its severities.
CPPCHECK_NOISE = (
    "functionStatic", "functionConst", "passedByValue", "useInitializationList", "constParameter", "constParameterPointer", "constParameterReference", "constVariable", "constVariablePointer", "constVariableReference", "unusedFunction", "unusedStructMember",
    "unusedVariable", "unmatchedSuppression", "missingInclude", "missingIncludeSystem", "unknownMacro", "toomanyconfigs", "normalCheckLevelMaxBranches", "checkersReport", "purgedConfiguration", "ConfigurationNotChecked", "noValidConfiguration", "missingOverride", "cstyleCast",
)
CPPCHECK_SEVERITY = {"error": "error", "warning": "warning", "style": "warning", "performance": "warning", "portability": "warning", "information": "note", "debug": "note"}
#: JSON shapes: tool -> (schema of the document, path of the array, file, line, column, code, message, severity).
JSON = {
    "ruff": ("array<struct<filename: string, code: string, message: string, location: struct<row: int, column: int>>>", None, "filename", "location.row", "location.column", "code", "message", None),
    "bandit": ("struct<results: array<struct<filename: string, line_number: int, col_offset: int, test_id: string, issue_text: string, issue_severity: string>>>", "results", "filename", "line_number", "col_offset", "test_id", "issue_text", "issue_severity"),
    "semgrep": ("struct<results: array<struct<path: string, check_id: string, start: struct<line: int, col: int>, extra: struct<message: string, severity: string>>>>", "results", "path", "start.line", "start.col", "check_id", "extra.message", "extra.severity"),
    "eslint": ("array<struct<filePath: string, messages: array<struct<ruleId: string, line: int, column: int, message: string, severity: int>>>>", None, None, None, None, None, None, None),
    "pip_audit": ("struct<dependencies: array<struct<name: string, version: string, vulns: array<struct<id: string, description: string>>>>>", None, None, None, None, None, None, None),
}


def parse_text(lines: DataFrame, tool: str, text: str = "value") -> DataFrame:
    """Findings of a tool's lines; lines of another shape, and notes, are passed over."""
    pattern, *places = TEXT[tool]
    part = lambda i: F.regexp_extract(text, pattern, i) if i else F.lit("")
    file, line, col, code, message = (part(i) for i in places)
    severity = F.when(F.col(text).rlike(r"(?i)(?:^|[ :])error"), "error").otherwise("warning")
    if tool == "flake8":
        severity = F.when(code.startswith("E"), "error").otherwise("warning")
    hit = F.col(text).rlike(pattern) & ~F.col(text).contains(": note:")
    if tool == "clang_tidy":  # the compiler itself reports what it cannot compile
        hit &= ~code.startswith("clang-diagnostic")
    number = lambda c: F.expr("1") * F.try_to_number(F.when(c == "", None).otherwise(c), F.lit("999999999")).cast("int")
    return lines.filter(hit).select(file.alias("file"), number(line).alias("line"), number(col).alias("col"), code.alias("code"), message.alias("message"), severity.alias("severity"), F.lit(tool).alias("tool"))


def parse_json(docs: DataFrame, tool: str, text: str = "value") -> DataFrame:
    """Findings of a tool's JSON documents; documents that cannot be read give none."""
    schema, at, *paths = JSON[tool]
    root = F.from_json(text, schema)
    if tool == "eslint":
        rows = docs.select(F.explode(root).alias("f")).select(F.col("f.filePath").alias("file"), F.explode("f.messages").alias("m"))
        return rows.select("file", F.col("m.line").alias("line"), F.col("m.column").alias("col"), F.coalesce("m.ruleId", F.lit("")).alias("code"), F.col("m.message").alias("message"), F.when(F.col("m.severity") == 2, "error").otherwise("warning").alias("severity"), F.lit(tool).alias("tool"))
    if tool == "pip_audit":
        rows = docs.select(F.explode(root["dependencies"]).alias("d")).select("d.name", "d.version", F.explode("d.vulns").alias("v"))
        return rows.select(F.lit("requirements.txt").alias("file"), F.lit(0).alias("line"), F.lit(0).alias("col"), F.col("v.id").alias("code"), F.concat_ws(" ", "name", "version", "v.description").alias("message"), F.lit("high").alias("severity"), F.lit(tool).alias("tool"))
    rows = docs.select(F.explode(root[at] if at else root).alias("r"))
    file, line, col, code, message, severity = (F.col(f"r.{p}") if p else F.lit(None).cast("string") for p in paths)
    return rows.select(file.alias("file"), line.alias("line"), col.alias("col"), F.coalesce(code, F.lit("")).alias("code"), message.alias("message"), F.lower(F.coalesce(severity, F.lit("warning"))).alias("severity"), F.lit(tool).alias("tool"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines of JSON; blank and broken ones are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def last_rows(df: DataFrame, n: int, order: str) -> DataFrame:
    return df.orderBy(F.desc(order)).limit(n)


def read_sources(spark: SparkSession, path: str, extensions: tuple[str, ...], most: int = 1000, skip=("node_modules", ".git", "venv", ".venv", "build", "dist", "target", "__pycache__")) -> DataFrame:
    """``file, text`` of source files by extension, without skipped folders; the first ``most`` by name (the feature's limit)."""
    options = {"recursiveFileLookup": True, "pathGlobFilter": "*{" + ",".join(extensions) + "}"}
    name = F.col("_metadata.file_path").alias("file")
    # names alone are put in order; a reader of binary files opens none for them
    names = spark.read.options(**options).format("binaryFile").load(path).select(name)
    names = names.filter(~F.arrays_overlap(F.split("file", "/"), F.array(*[F.lit(s) for s in skip]))).orderBy("file").limit(most)
    texts = spark.read.options(**options).text(path, wholetext=True).select(name, F.col("value").alias("text"))
    return texts.join(F.broadcast(names), "file")  # at most ``most`` rows


def applied_events(lines: DataFrame, text: str = "value") -> DataFrame:
    """Fields of "[applied] {...}" lines of an agent's log."""
    body = F.regexp_extract(text, r"\[applied\] (\{.*\})", 1)
    return lines.filter(F.col(text).contains("[applied]")).select(F.from_json(body, "file string, line int, code string, source string", {"allowSingleQuotes": "true"}).alias("e")).select("e.*")


def python_syntax(df: DataFrame, file: str = "file", text: str = "text") -> DataFrame:
    """Syntax errors of Python sources, by the parser itself (Arrow batches)."""
    import ast
    from collections.abc import Iterator

    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for f, t in zip(batch.column("file").to_pylist(), batch.column("text").to_pylist(), strict=True):
                try:
                    ast.parse(t or "")
                except (SyntaxError, ValueError, MemoryError, RecursionError) as e:
                    out.append({"file": f, "line": getattr(e, "lineno", None) or 0, "message": str(getattr(e, "msg", e))})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("file", pa.string()), ("line", pa.int32()), ("message", pa.string())]))

    return df.select(F.col(file).alias("file"), F.col(text).alias("text")).mapInArrow(run, "file string, line int, message string").withColumns({"code": F.lit("E999"), "severity": F.lit("error"), "tool": F.lit("ast")})


def sanitizer_findings(lines: DataFrame) -> DataFrame:
    """Headers of sanitizer logs ``file, n, text`` with the best of the 40 frames below: the first in the project, else the first that is not a system's."""
    from pyspark.sql import Window as W

    head = F.regexp_extract("text", r"==\d+==ERROR: (\w+Sanitizer): ([\w-]+)", 2)
    df = lines.withColumn("kind", F.when(head != "", head)).withColumn("_h", F.count("kind").over(W.partitionBy("file").orderBy("n").rowsBetween(W.unboundedPreceding, 0)))
    frame = r"^\s*#\d+ 0x[0-9a-f]+ in \S+ (\S+?):(\d+)"
    inner = W.partitionBy("file", "_h")
    df = df.filter("_h > 0").withColumn("_at", F.min("n").over(inner)).withColumn("where", F.regexp_extract("text", frame, 1)).withColumn("line", F.regexp_extract("text", frame, 2))
    system = F.col("where").rlike(r"^/(usr|lib|build)/")
    best = df.filter((F.col("where") != "") & (F.col("n") - F.col("_at") <= 40)).groupBy("file", "_h").agg(F.min(F.struct(system.cast("int"), "n", "where", "line")).alias("b"))
    kinds = df.filter("kind IS NOT NULL").select("file", "_h", "kind")
    rows = kinds.join(best, ["file", "_h"], "left").select("file", "kind", F.col("b.where").alias("source"), F.col("b.line").cast("int").alias("line"), F.concat(F.lit("SAN_"), F.upper(F.translate("kind", "-", "_"))).alias("code"))
    return rows.groupBy("source", "line", "code").agg(F.min("file").alias("file"), F.min("kind").alias("kind"))


def tracebacks(df: DataFrame, text: str = "text", project: str = r"(?!/)") -> DataFrame:
    """The last exception of each text and its deepest frame in the project (by default: relative paths)."""
    frame = F.regexp_extract_all(text, F.lit(r'(?m)^\s+File "([^"]+)", line \d+'), 1)
    line = F.regexp_extract_all(text, F.lit(r'(?m)^\s+File "[^"]+", line (\d+)'), 1)
    frames = F.filter(F.zip_with(frame, line, lambda f, n: F.struct(f.alias("file"), n.cast("int").alias("line"))), lambda x: x["file"].rlike("^" + project))
    error = F.element_at(F.regexp_extract_all(text, F.lit(r"(?m)^([A-Za-z_][\w.]*(?:Error|Exception|Warning|Exit|Interrupt))\b"), 1), -1)
    return df.select("*", F.try_element_at(frames, F.lit(-1)).alias("_f"), error.alias("code")).select(*df.columns, "_f.file", "_f.line", "code")


def test_failures(lines: DataFrame, text: str = "value") -> DataFrame:
    """Failed tests ``path, name`` of a test run's summary lines (FAILED or ERROR), each once."""
    shape = r"^(?:FAILED|ERROR)\s+([^\s:]+)::(\S+?)(?:\s+-\s+.*)?$"
    return lines.select(F.regexp_extract(text, shape, 1).alias("path"), F.regexp_extract(text, shape, 2).alias("name")).filter("path <> ''").distinct()


def _blocks(log: Column, head: str) -> Column:
    """What follows each line of a log that head matches (with the name as its group), up to the next: structs of name and body."""
    marked = F.regexp_replace(log, head, "\u0001$1\u0002")
    return F.transform(F.slice(F.split(marked, "\u0001"), 2, 1 << 30), lambda x: F.struct(F.substring_index(x, "\u0002", 1).alias("name"), F.substr(x, F.instr(x, "\u0002") + 1).alias("body")))


def cargo_failures(logs: DataFrame, text: str = "text") -> DataFrame:
    """Failed tests ``name, file, line, message`` of whole cargo logs: the blocks of their output, or else the names listed under "failures:"."""
    new = r"panicked at\s+([^\s:]+):(\d+):\d+:\s*\n\s*(.+)"
    old = r"(?s)panicked at\s+'?(.*?)'?\s*,\s*([^\s:]+):(\d+):\d+"
    rows = logs.withColumn("_b", _blocks(F.col(text), r"(?m)^----\s+(\S+)\s+stdout\s+----\s*$"))
    b = rows.select("*", F.explode("_b").alias("b")).select(*logs.columns, "b.*")
    first = lambda p, q, i, j: F.when(F.col("body").rlike(p), F.regexp_extract("body", p, i)).otherwise(F.regexp_extract("body", q, j))
    line, message = first(new, old, 2, 3), F.trim(first(new, old, 3, 1))
    found = b.select(*logs.columns, "name", first(new, old, 1, 2).alias("file"), F.coalesce(F.try_to_number(F.when(line != "", line), F.lit("999999999")).cast("int"), F.lit(0)).alias("line"), F.when(message != "", message).otherwise("test panicked").alias("message"))
    listed = F.regexp_extract(text, r"(?s)(?:^|\n)\s*failures:\s*\n((?:[ \t]*\S[^\n]*\n?)*)", 1)
    names = F.array_distinct(F.filter(F.transform(F.split(listed, "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("test result")))
    rest = rows.filter(F.size("_b") == 0).select(*logs.columns, F.explode(names).alias("name"), F.lit("").alias("file"), F.lit(0).alias("line"), F.lit("test failed").alias("message"))
    return found.unionByName(rest)


def jest_failures(logs: DataFrame, text: str = "text") -> DataFrame:
    """Failed tests ``name, file, line, message`` of whole jest logs: each bullet's block, its first script frame and first line."""
    frame = r"\(?([^\s()]+\.[jt]sx?):(\d+):\d+\)?"
    b = logs.select("*", F.explode(_blocks(F.col(text), r"(?m)^\s*\u25cf\s+(.+?)\s*$")).alias("b")).select(*logs.columns, "b.*")
    line, message = F.regexp_extract("body", frame, 2), F.trim(F.regexp_extract("body", r"(?m)^[ \t]*(\S.*)$", 1))
    return b.select(*logs.columns, "name", F.regexp_extract("body", frame, 1).alias("file"), F.coalesce(F.try_to_number(F.when(line != "", line), F.lit("999999999")).cast("int"), F.lit(0)).alias("line"), F.when(message != "", message).otherwise("test failed").alias("message"))


def cppcheck_findings(docs: DataFrame, text: str = "value") -> DataFrame:
    """Findings of cppcheck's XML documents, at their first place; noise, findings without a place and broken documents give none."""
    schema = "errors struct<error: array<struct<_id: string, _severity: string, _msg: string, _verbose: string, location: array<struct<_file: string, _line: string, _column: string>>>>>"
    e = docs.select(F.explode(F.from_xml(F.col(text), schema)["errors"]["error"]).alias("e")).select("e.*")
    name, place = F.coalesce("_id", F.lit("unknown")), F.try_element_at("location", F.lit(1))
    number = lambda c: F.coalesce(F.expr("1") * F.try_to_number(F.when(c != "", c), F.lit("999999999")).cast("int"), F.lit(0))
    severity = F.coalesce(F.create_map(*[F.lit(x) for pair in CPPCHECK_SEVERITY.items() for x in pair])[F.coalesce("_severity", F.lit("warning"))], F.lit("warning"))
    message = F.trim(F.coalesce(F.when(F.col("_msg") != "", F.col("_msg")), "_verbose", F.lit("")))
    rows = e.filter(~name.isin(*CPPCHECK_NOISE) & place.isNotNull())
    return rows.select(F.coalesce(place["_file"], F.lit("")).alias("file"), number(place["_line"]).alias("line"), number(place["_column"]).alias("col"), F.concat(F.lit("cppcheck::"), name).alias("code"), message.alias("message"), severity.alias("severity"), F.lit("cppcheck").alias("tool"))


def cargo_audit(docs: DataFrame, manifests: DataFrame, by: list[str], text: str = "value") -> DataFrame:
    """Advisories of cargo's audit reports (JSON, one a row, ``by, value``), with the first fixed version and the first line of the manifest that names the package (0: none).

    manifests: ``by, line, text`` of Cargo.toml files.  Lines are joined by their words, so a package costs as much as lines name it.
    Sizes of exploded rows are underestimated by far, so the join asks for a shuffle: no side may go through the driver.
    """
    advisory = "advisory: struct<id: string, title: string, severity: string, patched: array<string>>"
    schema = f"vulnerabilities struct<list: array<struct<{advisory}, package: struct<name: string, version: string>, versions: struct<patched: array<string>>>>>"
    v = docs.select(*by, F.explode(F.from_json(text, schema)["vulnerabilities"]["list"]).alias("v")).select(*by, "v.*")
    patched = F.when(F.size(F.coalesce("versions.patched", F.array().cast("array<string>"))) > 0, F.col("versions.patched")).otherwise(F.coalesce("advisory.patched", F.array().cast("array<string>")))
    versions = F.filter(F.transform(patched, lambda x: F.regexp_extract(x, r"(\d+\.\d+\.\d+)", 1)), lambda x: x != "")
    none = lambda c, other="": F.coalesce(c, F.lit(other))
    package = none("package.name")
    message = F.concat(none("advisory.title"), F.lit(": "), package, F.lit(" "), none("package.version"))
    rows = v.select(*by, package.alias("_package"), none("advisory.id").alias("code"), message.alias("message"), none("advisory.severity", "unknown").alias("severity"), F.try_element_at(versions, F.lit(1)).alias("fix_version"))
    # A name stands in a line as a whole when it is a run of its words: all runs of words and marks of the line's names are its keys.
    words = F.regexp_extract_all("text", F.lit(r"([\w-]+)"), 1)
    runs = F.flatten(F.transform(words, lambda x: F.transform(F.sequence(F.lit(1), F.size(F.split(x, "-"))), lambda i: F.transform(F.sequence(i, F.size(F.split(x, "-"))), lambda j: F.array_join(F.slice(F.split(x, "-"), i, j - i + 1), "-")))))
    first = manifests.select(*by, "line", F.explode(F.array_distinct(F.flatten(runs))).alias("_package")).groupBy(*by, "_package").agg(F.min("line").alias("_line"))
    return rows.join(first.hint("merge"), [*by, "_package"], "left").select(*by, F.lit("Cargo.toml").alias("file"), F.coalesce("_line", F.lit(0)).cast("int").alias("line"), F.lit(0).alias("col"), "code", "message", "severity", "fix_version", F.lit("cargo_audit").alias("tool"))


def verify_records(docs: DataFrame, text: str = "value") -> DataFrame:
    """``file, code, verdict`` of the accepted fixes in verification results (JSON documents); broken documents give none."""
    records = F.from_json(text, "verify_accepts array<struct<file: string, code: string, verdict: string>>")["verify_accepts"]
    return docs.select(F.explode(records).alias("v")).select("v.*")


def rustc_messages(docs: DataFrame, text: str = "value", lint: bool = False) -> DataFrame:
    """Compiler messages of cargo's JSON lines, at their first span; lint: clippy's, warnings and errors with a place, all of them warnings."""
    schema = "reason string, message struct<level: string, code: struct<code: string>, message: string, spans: array<struct<file_name: string, line_start: int, column_start: int>>>"
    m = docs.select(F.from_json(text, schema).alias("d")).filter("d.reason = 'compiler-message'").select("d.message.*")
    first = F.try_element_at("spans", F.lit(1))
    if lint:
        m = m.filter(F.col("level").isin("warning", "error") & (F.coalesce(first["file_name"], F.lit("")) != "")).withColumn("level", F.lit("warning"))
    return m.select(first["file_name"].alias("file"), first["line_start"].alias("line"), first["column_start"].alias("col"), F.coalesce("code.code", F.lit("")).alias("code"), "message", F.col("level").alias("severity"), F.lit("clippy" if lint else "rustc").alias("tool"))


def compile_commands(docs: DataFrame, text: str = "value") -> DataFrame:
    """``file, flag`` of a compile database."""
    rows = docs.select(F.explode(F.from_json(text, "array<struct<file: string, command: string>>")).alias("c"))
    return rows.select("c.file", F.explode(F.split("c.command", r"\s+")).alias("flag")).filter("flag LIKE '-%'")


def project_tree(files: DataFrame, most: int = 2000) -> DataFrame:
    """``path, kind, depth`` of files ``file`` and all folders above them, folders first; at most so many (the feature's limit), and whether there are more."""
    from pyspark.sql import Window as W

    parts = F.split("file", "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    folders = files.filter(F.size(parts) > 1).select(F.explode(above).alias("path"), F.lit("folder").alias("kind")).distinct()
    rows = folders.unionByName(files.select(F.col("file").alias("path"), F.lit("file").alias("kind")).distinct()).withColumn("depth", F.size(F.split("path", "/")) - 1)
    first = rows.orderBy(F.desc("kind"), "path").limit(most + 1)
    return first.withColumn("_n", F.row_number().over(W.orderBy(F.desc("kind"), "path"))).withColumn("truncated", F.max("_n").over(W.partitionBy()) > most).filter(F.col("_n") <= most).drop("_n")
