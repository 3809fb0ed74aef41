"""Scanners that need a parser: comments, functions, literals, doc strings, macros and diffs of Python, C and other sources.

Each is a function from a text to rows, run over Arrow batches; a text that cannot be parsed, or is too complex for the parser, gives no rows.
"""

from __future__ import annotations

import ast
import bisect
import difflib
import io
import re
import tokenize
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

# Calls with effects, those that count as high, and code that is dangerous in comments.
EFFECTS = {"open": "file", "print": "output", "exec": "exec", "eval": "exec", "system": "process", "run": "process", "Popen": "process", "remove": "file", "unlink": "file", "urlopen": "network", "get": "network", "post": "network"}
HIGH_EFFECTS = ("exec", "process", "network")
SPIKE = 5
DANGEROUS = re.compile(r"\b(?:eval|exec|os\.system|pickle\.loads?|subprocess)\s*\(|shell\s*=\s*True")
#: Rows of texts that a task hands on together.
FLUSH = 2048
DEFINE = re.compile(r"^\s*#\s*define\s+(\w+)(\([^)]*\))?\s*(.*)$")


def exploded(batches: Iterator[pa.RecordBatch], rows: Callable[[str], list[dict]], schema: pa.Schema, key: str, text: str) -> Iterator[pa.RecordBatch]:
    """The key and the rows of each text of some batches; besides a batch of texts only the rows of some texts are held, until they are FLUSH."""
    out = []
    for batch in batches:
        for k, t in zip(batch.column(key), batch.column(text), strict=True):
            name = k.as_py()
            out += [{key: name, **row} for row in rows(t.as_py() or "")]
            if len(out) >= FLUSH:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def explode_text(df: DataFrame, rows: Callable[[str], list[dict]], schema: str, arrow: pa.Schema, key: str = "file", text: str = "text") -> DataFrame:
    """key and the rows of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from exploded(batches, rows, pa.schema([pa.field(key, pa.string()), *arrow]), key, text)

    return df.select(F.col(key).cast("string").alias(key), F.col(text).alias(text)).mapInArrow(run, f"`{key}` string, {schema}")


def _comments(text: str) -> list[dict]:
    out = []
    try:
        for t in tokenize.generate_tokens(io.StringIO(text).readline):
            if t.type == tokenize.COMMENT and DANGEROUS.search(t.string):
                out.append({"line": t.start[0], "text": t.string})
    except (tokenize.TokenError, SyntaxError, ValueError, MemoryError, RecursionError):
        pass
    return out


def code_in_comments(df: DataFrame, **names) -> DataFrame:
    """Comments (by the tokenizer, so # in strings is none) that hold dangerous code."""
    return explode_text(df, _comments, "line int, text string", pa.schema([("line", pa.int32()), ("text", pa.string())]), **names)


def _functions(text: str) -> list[dict]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, MemoryError, RecursionError):
        return []
    out = {}
    for node in ast.walk(tree):
        if not isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            continue
        a = node.args
        positional = a.posonlyargs + a.args
        inner = list(ast.walk(node))
        called = {getattr(c.func, "id", getattr(c.func, "attr", "")) for c in inner if isinstance(c, ast.Call)} - {""}
        raised = {getattr(e, "id", getattr(e, "attr", "")) for r in inner if isinstance(r, ast.Raise) and r.exc for e in [r.exc.func if isinstance(r.exc, ast.Call) else r.exc]} - {""}
        out[node.name] = {
            "name": node.name,
            "params": [x.arg for x in positional + a.kwonlyargs],
            "required": max(0, len(positional) - len(a.defaults)) + sum(d is None for d in a.kw_defaults),
            "returns": any(isinstance(r, ast.Return) and r.value is not None for r in inner),
            "raised": sorted(raised),
            "called": sorted(called),
            "branches": sum(isinstance(b, (ast.If, ast.For, ast.While, ast.Try, ast.IfExp, ast.BoolOp, ast.comprehension)) for b in inner),
            "effects": sorted({EFFECTS[c] for c in called if c in EFFECTS}),
        }
    return list(out.values())


FUNCTION = "name string, params array<string>, required int, returns boolean, raised array<string>, called array<string>, branches int, effects array<string>"
_LIST = pa.list_(pa.string())
_FUNCTION = pa.schema([("name", pa.string()), ("params", _LIST), ("required", pa.int32()), ("returns", pa.bool_()), ("raised", _LIST), ("called", _LIST), ("branches", pa.int32()), ("effects", _LIST)])


def functions_of(df: DataFrame, **names) -> DataFrame:
    """Features of each function; of several with one name the last."""
    return explode_text(df, _functions, FUNCTION, _FUNCTION, **names)


def logic_changes(before: DataFrame, after: DataFrame, key: str = "file") -> DataFrame:
    """Violations ``file, name, type, severity`` of functions that both sides have.  The comparison is a join of features; only they come from the parser."""
    b = before.select(key, "name", *[F.col(c).alias(f"b_{c}") for c in before.columns if c not in (key, "name")])
    both = after.join(b, [key, "name"])
    c = F.col
    lost = lambda x: F.size(F.array_except(f"b_{x}", x))
    new = lambda x: F.size(F.array_except(x, f"b_{x}"))
    high = F.arrays_overlap(F.array_except("effects", "b_effects"), F.array(*[F.lit(e) for e in HIGH_EFFECTS]))
    tests = [
        (c("required") > c("b_required"), "REQUIRED_PARAM_ADDED", F.lit("high")),
        (lost("params") > 0, "PARAM_REMOVED", F.lit("high")),
        (c("b_returns") & ~c("returns"), "RETURN_PATH_LOST", F.lit("high")),
        (new("raised") > 0, "EXCEPTION_ADDED", F.lit("medium")),
        (lost("called") > 0, "CALL_REMOVED", F.lit("medium")),
        (new("called") > 0, "CALL_ADDED", F.lit("medium")),
        (c("branches") - c("b_branches") >= SPIKE, "COMPLEXITY_SPIKE", F.lit("medium")),
        (new("effects") > 0, "SIDE_EFFECT_ADDED", F.when(high, "high").otherwise("medium")),
        (lost("effects") > 0, "SIDE_EFFECT_REMOVED", F.lit("medium")),
    ]
    hits = F.array_compact(F.array(*[F.when(t, F.struct(F.lit(k).alias("type"), s.alias("severity"))) for t, k, s in tests]))
    return both.select(key, "name", F.explode(hits).alias("v")).select(key, "name", "v.*")


def _literals(text: str) -> list[dict]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, MemoryError, RecursionError):
        return [{"bytes": len(re.findall(r"\bb[\"']", text)), "numbers": 0, "parsed": False}]
    kinds = [type(n.value) for n in ast.walk(tree) if isinstance(n, ast.Constant)]
    return [{"bytes": kinds.count(bytes), "numbers": sum(k in (int, float, complex) for k in kinds), "parsed": True}]


def literal_counts(df: DataFrame, **names) -> DataFrame:
    """Bytes and numeric literals of each text; what cannot be parsed counts bytes by pattern and no numbers."""
    return explode_text(df, _literals, "bytes int, numbers int, parsed boolean", pa.schema([("bytes", pa.int32()), ("numbers", pa.int32()), ("parsed", pa.bool_())]), **names)


RUST_ITEM = re.compile(r"\s*(?:pub\s+)?(?:async\s+)?(fn|struct|enum|trait)\s+([A-Za-z_]\w*)")
JS_ITEM = re.compile(r"\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:(?:function|(class))\s+([A-Za-z_$][\w$]*)|(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s+)?(?:function|\([^)]*\)\s*=>)|([A-Za-z_$][\w$]*)\s*\([^)]*\)\s*\{)")
CODE_LINES, BODY_LINES = 60, 81


def _cut(lines: list[str]) -> str:
    more = len(lines) - CODE_LINES
    return "\n".join(lines[:CODE_LINES] + ([f"// ... [{more} more lines truncated]"] if more > 0 else []))


def _item(lines: list[str], at: int, end: str | None) -> str:
    """Code from a declaration to the brace that closes it, or to a line that ends with ``end`` before any brace."""
    depth, opened, n = 0, False, 0
    for n, x in enumerate(lines[at : at + BODY_LINES], 1):
        opened = opened or "{" in x
        depth += x.count("{") - x.count("}")
        if (opened and depth <= 0) or (end and not opened and x.rstrip().endswith(end)):
            break
    return _cut(lines[at : at + n])


def _python_docs(text: str) -> list[dict]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, MemoryError, RecursionError):
        return []
    lines = text.splitlines()
    found = [n for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))]
    docs = ((n, (ast.get_docstring(n) or "").strip()) for n in found)
    return [{"name": n.name, "kind": "class" if isinstance(n, ast.ClassDef) else "function", "doc": d, "line": n.lineno, "code": _cut(lines[n.lineno - 1 : n.end_lineno])} for n, d in docs if d]


def _rust_docs(text: str) -> list[dict]:
    lines, out, doc = text.splitlines(), [], []
    pending = False  # a block of comments has ended, attributes may follow
    for at, x in enumerate(lines):
        start = x.strip()[:3]
        if start in ("///", "//!"):
            doc = ([] if pending else doc) + [re.sub(r"^\s*//[/!]\s?", "", x)]
            pending = False
        elif doc:
            pending = True
            if not start.startswith("#["):
                if m := RUST_ITEM.match(x):
                    out.append({"name": m[2], "kind": m[1], "doc": "\n".join(doc).strip(), "line": at + 1, "code": _item(lines, at, ";")})
                doc, pending = [], False
    return out


def _js_docs(text: str) -> list[dict]:
    lines, out, at = text.splitlines(), [], 0
    full = [n for n, x in enumerate(lines) if x.strip()]
    while at < len(lines):
        if "/**" not in lines[at]:
            at += 1
            continue
        end = next((n for n in range(at, len(lines)) if "*/" in lines[n]), len(lines))
        place = bisect.bisect_right(full, end)
        m = JS_ITEM.match(lines[full[place]]) if place < len(full) else None
        if m:
            doc = (re.sub(r"^\*\s?", "", re.sub(r"\*/$", "", re.sub(r"^/\*\*?", "", x.strip()))).strip() for x in lines[at : end + 1])
            out.append({"name": m[2] or m[3] or m[4], "kind": "class" if m[1] else "function", "doc": "\n".join(d for d in doc if d), "line": full[place] + 1, "code": _item(lines, full[place], None)})
        at = end + 1
    return out


DOCS = {"python": _python_docs, "rust": _rust_docs, "js": _js_docs}


def docstrings(df: DataFrame, language: str = "python", **names) -> DataFrame:
    """Documented items ``name, kind, doc, line, code`` of each text; code is cut after 60 lines (the feature's limit)."""
    arrow = pa.schema([("name", pa.string()), ("kind", pa.string()), ("doc", pa.string()), ("line", pa.int32()), ("code", pa.string())])
    return explode_text(df, DOCS[language], "name string, kind string, doc string, line int, code string", arrow, **names)


def _macros(text: str) -> list[dict]:
    text = re.sub(r"/\*.*?\*/", lambda m: "\n" * m[0].count("\n"), text, flags=re.S)
    out, lines, i = [], text.splitlines(), 0
    while i < len(lines):
        at, m = i, DEFINE.match(lines[i].split("//")[0])
        i += 1
        if not m:
            continue
        body = [m[3].rstrip()]
        while body[-1].endswith("\\") and i < len(lines):
            body[-1] = body[-1][:-1].rstrip()
            body.append(lines[i].split("//")[0].rstrip())
            i += 1
        out.append({"name": m[1], "line": at + 1, "params": [p.strip() for p in (m[2] or "()")[1:-1].split(",") if p.strip()], "body": "\n".join(b for b in body if b).strip()})
    return out


def macros(df: DataFrame, **names) -> DataFrame:
    """C macros with bodies over several lines; comments do not count."""
    return explode_text(df, _macros, "name string, line int, params array<string>, body string", pa.schema([("name", pa.string()), ("line", pa.int32()), ("params", _LIST), ("body", pa.string())]), **names)


def relevant_macros(errors: DataFrame, table: DataFrame, most: int = 5) -> DataFrame:
    """Per error ``id, line_text, message``: the first macros that its texts name, upper-case names first."""
    upper, any_ = r"\b([A-Z_][A-Z0-9_]+)\b", r"\b([A-Za-z_]\w*)\b"
    names = F.array_distinct(F.concat(F.regexp_extract_all("line_text", F.lit(upper), 1), F.regexp_extract_all("message", F.lit(upper), 1), F.regexp_extract_all("line_text", F.lit(any_), 1)))
    found = errors.select("id", F.posexplode(names).alias("at", "name")).join(table.select("name", "body").distinct(), "name")
    return found.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct("at", "name"))), 1, most).alias("m")).select("id", F.array_join(F.transform("m", lambda x: x["name"]), ",").alias("macros"))


def changed_hunks(before: Column, after: Column, line: Column, near: int = 3) -> Column:
    """Opcodes of the line diff of two texts within some lines of a place, as "tag:from-to>from-to"."""

    @F.pandas_udf("array<string>")
    def diff(b, a, at):
        import pandas as pd

        out = []
        for x, y, n in zip(b.fillna(""), a.fillna(""), at.fillna(0)):
            ops = difflib.SequenceMatcher(None, x.splitlines(), y.splitlines(), autojunk=False).get_opcodes()
            out.append([f"{t}:{i}-{j}>{k}-{m}" for t, i, j, k, m in ops if t != "equal" and i - near <= n - 1 <= j + near])
        return pd.Series(out)

    return diff(before, after, line)


def python_edges(files: DataFrame) -> DataFrame:
    """``src, dst`` of imports between the given files: module.py or module/__init__.py."""
    line = F.explode(F.split("text", "\n"))
    module = F.regexp_extract("l", r"^\s*(?:import|from)\s+([A-Za-z_]\w*)", 1)
    used = files.select(F.col("file").alias("src"), line.alias("l")).select("src", module.alias("m")).filter("m <> ''")
    there = files.select(F.col("file").alias("dst"), F.regexp_replace("file", r"(/__init__)?\.py$", "").alias("m")).filter("NOT contains(m, '/')")
    return used.join(there, "m").select("src", "dst").distinct()


def _found(used: DataFrame, files: DataFrame) -> DataFrame:
    """Edges from src to the first of its candidate paths that is a file."""
    tried = used.select("src", "name", F.posexplode("paths").alias("_n", "dst"))
    there = tried.join(files.select(F.col("file").alias("dst")).distinct(), "dst")
    return there.groupBy("src", "name").agg(F.min_by("dst", "_n").alias("dst")).select("src", "dst").distinct()


def rust_edges(files: DataFrame) -> DataFrame:
    """``src, dst`` of "mod x;" lines: x.rs or x/mod.rs beside the file."""
    used = files.select(F.col("file").alias("src"), F.explode(F.regexp_extract_all("text", F.lit(r"(?m)^\s*mod\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*;"), 1)).alias("name")).distinct()
    path = F.concat(F.regexp_extract("src", r"^(.*/)?[^/]*$", 1), "name")
    return _found(used.withColumn("paths", F.array(F.concat(path, F.lit(".rs")), F.concat(path, F.lit("/mod.rs")))), files)


def plain_path(path: Column) -> Column:
    """The path without ".", ".." and empty parts; null if it leaves the root."""

    def step(s: Column, x: Column) -> Column:
        up = F.when(F.size(s) > 0, F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))))
        return F.when(x.isin("", "."), s).when(x == "..", up).otherwise(F.concat(s, F.array(x)))

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def js_edges(files: DataFrame) -> DataFrame:
    """``src, dst`` of relative imports and requires of .js and .ts files: the path itself, with .js or .ts, or the index of the folder."""
    quoted = r"[\"']([^\"']+)[\"']"
    calls = F.regexp_extract_all("text", F.lit(r"import\s+.*?\s+from\s+" + quoted + r"|require\(" + quoted + r"\)"), 0)
    name = F.regexp_extract("call", quoted + r"\)?$", 1)
    used = files.filter(F.col("file").rlike(r"\.[jt]s$")).select(F.col("file").alias("src"), F.explode(calls).alias("call")).select("src", name.alias("name")).filter("name LIKE '.%'").distinct()
    base = plain_path(F.concat(F.regexp_extract("src", r"^(.*/)?[^/]*$", 1), F.regexp_extract("name", r"^([^?#]*)", 1)))
    return _found(used.withColumn("paths", F.array(*[F.concat(base, F.lit(x)) for x in ("", ".js", ".ts", "/index.js", "/index.ts")])), files)


#: Lines that define a symbol, by language: (pattern, group of the kind or the kind itself, group of the name).
SYMBOLS = {
    "python": ((r"^\s*(?:async\s+)?def\s+([A-Za-z_]\w*)", "function", 1), (r"^\s*class\s+([A-Za-z_]\w*)", "class", 1)),
    "rust": ((r"^\s*(?:pub(?:\([^)]+\))?\s+)?(?:async\s+)?(fn|struct|enum|trait|union|type|const|static|mod)\s+([A-Za-z_]\w*)", 1, 2),),
    "js": tuple((r"^\s*(?:export\s+)?" + p, kind, 1) for p, kind in (
        (r"(?:default\s+)?(?:async\s+)?function\s+([A-Za-z_$][\w$]*)", "function"), (r"(?:default\s+)?class\s+([A-Za-z_$][\w$]*)", "class"), (r"(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=", "binding"), (r"interface\s+([A-Za-z_$][\w$]*)", "interface"), (r"type\s+([A-Za-z_$][\w$]*)", "type"),
    )),
}


def symbol_index(lines: DataFrame, language: str) -> DataFrame:
    """``file, line, name, kind, signature`` (the line, cut to 200 characters) of the lines that define something."""
    shapes = [F.when(F.col("text").rlike(p), F.struct(F.regexp_extract("text", p, n).alias("name"), (F.regexp_extract("text", p, k) if isinstance(k, int) else F.lit(k)).alias("kind"))) for p, k, n in SYMBOLS[language]]
    rows = lines.select("file", "line", "text", F.explode(F.array_compact(F.array(*shapes))).alias("s"))
    return rows.select("file", "line", "s.name", "s.kind", F.substring(F.trim("text"), 1, 200).alias("signature"))


def erosion(before: Column, after: Column, code: Column) -> Column:
    """Whether a patch added marks of given-up typing, for a code that could be fixed properly."""
    # Marks of given-up typing.
    marks = (r":\s*Any\b", r"#\s*type:\s*ignore", r"\bcast\s*\(\s*Any\b", r"->\s*object\b")
    grew = F.lit(False)
    for m in marks:
        grew = grew | (F.regexp_count(F.coalesce(after, F.lit("")), F.lit(m)) > F.regexp_count(F.coalesce(before, F.lit("")), F.lit(m)))
    return grew & ~code.isin("import-untyped", "import-not-found", "untyped-decorator")
