"""Line scanners: security rules, authorship signs, symbols, imports and grep, as expressions over exploded lines."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tallyloom.functions.text import let, split_lines

# Names and words on which the rules' results depend.
SECRET_WORDS = ("secret", "passwd", "password", "pwd", "token", "api[_-]?key", "apikey", "access[_-]?key", "private[_-]?key", "auth[_-]?token", "client[_-]?secret")
ENV_READS = (r"os\.environ", r"os\.getenv", "getenv", r"process\.env", "std::env::var", "dotenv", r"environ\[")
CSHARP_CONFIG = ("GetEnvironmentVariable", "IConfiguration")
SQL_WORDS = ("SELECT", "INSERT", "UPDATE", "DELETE", "FROM", "WHERE")
RUST_QUERIES = ("query", "query_as", "query_scalar", "execute", "sql_query", "batch_execute")
CSHARP_QUERIES = ("SqlCommand", "CommandText", "OleDbCommand", "MySqlCommand", "NpgsqlCommand", "FromSqlRaw", "ExecuteSqlRaw")
CSHARP_READERS = ("BinaryFormatter", "NetDataContractSerializer", "LosFormatter", "SoapFormatter", "ObjectStateFormatter")
CPP_RUNNERS = ("system", "popen", "_popen", "execlp", "execvp")
CPP_UNBOUNDED = ("strcpy", "strcat", "sprintf", "gets", "vsprintf", "scanf")
CPP_BOUNDED = ("strncpy", "strncat", "snprintf", "vsnprintf", "fgets")
SHELLS = ("sh", "bash", "zsh", "cmd", "powershell")
PLACEHOLDERS = ("TODO", "FIXME", "XXX", "HACK", r"implementation\s+here", r"your\s+code\s+here", r"add\s+(?:logic|implementation|code)\s+here", "placeholder", r"\.\.\.", "unimplemented!")
#: White space at a line's ends.
BLANKS = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
AUTHORSHIP = {"placeholders": 0.30, "repeated_lines": 0.20, "long_names": 0.15, "unused_imports": 0.15, "mixed_style": 0.20}
COMMENT = {"python": ("#",), "js": ("//", "*", "/*"), "rust": ("//",), "csharp": ("//", "*", "/*"), "cpp": ("//", "*", "/*")}


def _any(words: tuple[str, ...], before: str = "", after: str = "") -> str:
    """A pattern for any of the words; word characters are those of Unicode."""
    return f"(?U){before}(?:{'|'.join(words)}){after}"


def has(pattern: str) -> Callable[[Column], Column]:
    return lambda line: line.rlike(pattern)


def calls(*names: str) -> Callable[[Column], Column]:
    """A call of one of the names that is neither a method nor the end of a longer name."""
    return has(_any(names, r"(?<![.\w])", r"\s*\("))


def both(*tests: Callable[[Column], Column], but: Callable[[Column], Column] | None = None) -> Callable[[Column], Column]:
    def test(line: Column) -> Column:
        hit = F.lit(True)
        for t in tests:
            hit = hit & t(line)
        return hit & ~but(line) if but else hit

    return test


def secret(declared: str, quotes: str, least: int, but: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """The line's first declaration gives a name of a secret a literal of ``least`` characters or more.

    declared: a pattern of what comes before the quote, with the name as its group.
    """
    literal = "|".join(f"{q}([^{q}]*){q}" for q in quotes)
    whole = f"(?U){declared}\\s*=\\s*(?:{literal})"

    def test(line: Column) -> Column:
        name = F.regexp_extract(line, whole, 1)
        value = F.concat(*[F.regexp_extract(line, whole, i + 2) for i in range(len(quotes))])
        return name.rlike("(?i)" + "|".join(SECRET_WORDS)) & (F.length(value) >= least) & ~but(line)

    return test


def sql_text(quotes: str) -> Callable[[Column], Column]:
    return has(f"(?i)[{quotes}].*" + _any(SQL_WORDS, r"\b", r"\b"))


FROM_ENV = has("(?i)" + "|".join(ENV_READS))
CSHARP_BUILT = has(r"\$\"|\"\s*\+|\+\s*\"|String\.Format")
#: family -> (code, severity, confidence, autofixable, test of a line)
RULES = {
    "python": [
        ("hardcoded_secret", "high", 0.85, True, secret(r"^\s*([A-Za-z_][A-Za-z0-9_.]*)", "'\"", 6, FROM_ENV)),
        ("dangerous_eval", "high", 0.70, False, calls("eval", "exec")),
        ("unsafe_deserialization", "high", 0.85, True, calls(r"yaml\.load", r"pickle\.loads?")),
        ("sql_injection", "high", 0.60, False, both(has(r"\.execute(?:many)?\s*\("), sql_text("'\""), has(r"\+|%|\.format\s*\(|f['\"]"))),
        ("command_injection", "high", 0.60, False, lambda line: calls(r"os\.system")(line) | has(r"shell\s*=\s*True")(line)),
    ],
    "js": [
        ("hardcoded_secret", "high", 0.85, False, secret(r"(?:const|let|var)\s+([A-Za-z0-9_$]+)", "'\"`", 6, FROM_ENV)),
        ("dangerous_eval", "high", 0.70, False, lambda line: calls("eval")(line) | has(r"new\s+Function\s*\(")(line)),
        ("xss", "high", 0.80, True, has(r"\.(?:inner|outer)HTML\s*=(?!=)|document\.write\s*\(|\.insertAdjacentHTML\s*\(")),
        ("command_injection", "high", 0.60, False, has(r"(?U)child_process|(?<![.\w])exec(?:Sync)?\s*\([^)]*\+")),
    ],
    "rust": [
        ("hardcoded_secret", "high", 0.85, False, secret(r"let\s+(?:mut\s+)?([A-Za-z0-9_]+)\s*(?::\s*&?[A-Za-z0-9_]+\s*)?", '"', 4, FROM_ENV)),
        ("command_injection", "high", 0.60, False, has(r"\.arg\s*\(\s*\"-c\"\s*\)|Command::new\s*\(\s*\"(?:" + "|".join(SHELLS) + r")\"\s*\)")),
        ("unsafe_deserialization", "medium", 0.70, False, has("serde_pickle|bincode::deserialize")),
        ("sql_injection", "high", 0.60, False, both(has(_any(RUST_QUERIES, r"\b", r"\s*\(")), sql_text("'\""), has(r"format!\s*\(|\+\s*&|\.push_str\s*\(|\"\s*\+"), but=has("AssertSqlSafe"))),
    ],
    "csharp": [
        ("hardcoded_secret", "high", 0.85, False, secret(r"(?:const\s+string|readonly\s+string|string|var)\s+([A-Za-z0-9_]+)", '"', 4, lambda line: FROM_ENV(line) | has("|".join(CSHARP_CONFIG))(line))),
        ("sql_injection", "high", 0.60, False, both(has(_any(CSHARP_QUERIES, r"\b", r"\b")), sql_text("'\"$"), CSHARP_BUILT)),
        ("command_injection", "high", 0.60, False, both(has(_any((r"Process\.Start", "ProcessStartInfo"), r"\b", r"\b")), CSHARP_BUILT)),
        ("unsafe_deserialization", "high", 0.75, False, has(_any(CSHARP_READERS, r"\b", r"\b"))),
    ],
    "cpp": [
        ("hardcoded_secret", "high", 0.85, False, secret(r"(?:const\s+)?(?:char\s*\*|std::string|auto|string)\s+([A-Za-z0-9_]+)", '"', 4, has("getenv"))),
        ("command_injection", "high", 0.60, False, both(has(_any(CPP_RUNNERS, r"\b", r"\s*\(")), has(r"\+|\.c_str\s*\(\)|sprintf|snprintf|format"))),
        ("buffer_overflow", "high", 0.70, False, both(has(_any(CPP_UNBOUNDED, r"\b", r"\s*\(")), but=has(_any(CPP_BOUNDED, r"\b", r"\b")))),
    ],
}


def security_scan(lines: DataFrame, family: str) -> DataFrame:
    """Findings of a family's rules in ``file, line, text``; lines that begin as a comment are passed over.

    All rules are one array expression, so a line is read once and exploded only into its hits.
    """
    text = F.coalesce("text", F.lit(""))
    stripped = F.regexp_replace(text, r"^\s+", "")
    comment = F.lit(False)
    for c in COMMENT[family]:
        comment = comment | stripped.startswith(c)
    hits = F.array_compact(F.array(*[F.when(test(text), F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence"), F.lit(fix).alias("autofixable"))) for code, severity, confidence, fix, test in RULES[family]]))
    column = (F.length(text) - F.length(stripped) + 1).alias("col")
    return lines.filter(~comment).select("file", "line", column, F.explode(hits).alias("h")).select("file", "line", "col", "h.*", F.lit("SECURITY").alias("error_class"))


def _last_names(text: Column, pattern: str, mark: str) -> Column:
    """The last part of each name that a line-wise pattern finds."""
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), 1), lambda x: F.element_at(F.split(x, mark), -1))


def authorship(df: DataFrame, text: str = "text") -> DataFrame:
    """Signs of generated code in each text, and their weighted score.

    placeholders: their share of the lines, tenfold; repeated_lines: how often the most frequent line of ten characters
    stands there; long_names: distinct ones of 35 characters; unused_imports: the share of imports whose last name
    stands nowhere else; mixed_style: tabs and spaces, line ends, and styles of function names.  Each is at most 1; an empty or blank text has none.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    lines = split_lines(F.col(text))
    n = F.greatest(F.size(lines), F.lit(1))
    # patterns with Unicode classes are slow: each runs only on texts that a plain one lets through
    marked = t.rlike("(?i)" + "|".join(PLACEHOLDERS))
    placeholders = F.when(marked, F.least(F.lit(1.0), F.size(F.filter(lines, lambda x: x.rlike("(?i)" + _any(PLACEHOLDERS, r"\b", r"\b")))) / n * 10)).otherwise(0.0)
    kept = F.filter(F.transform(lines, lambda x: F.btrim(x, F.lit(BLANKS))), lambda x: (F.length(x) >= 10) & ~x.rlike(r"^(#|//|/\*|\*)"))
    # the longest run of equal lines once they are sorted; no quadratic comparison within a text
    run = F.aggregate(F.array_sort(kept), F.struct(F.lit("").alias("v"), F.lit(0).alias("k"), F.lit(0).alias("best")), lambda s, x: F.struct(x.alias("v"), F.when(x == s["v"], s["k"] + 1).otherwise(1).alias("k"), F.greatest(s["best"], F.when(x == s["v"], s["k"] + 1).otherwise(1)).alias("best")))["best"]
    repeated = F.when(run < 3, 0.0).otherwise(F.least(F.lit(1.0), (run - 2) / 6))
    names = F.when(t.rlike("[A-Za-z0-9_]{35}"), F.least(F.lit(1.0), F.size(F.array_distinct(F.regexp_extract_all(t, F.lit(r"(?U)\b([A-Za-z_][A-Za-z0-9_]{34,})\b"), 1))) / 5)).otherwise(0.0)
    imported = F.concat(_last_names(t, r"(?mdU)^\s*use\s+([A-Za-z_][\w:]*)", "::"), _last_names(t, r"(?mdU)^\s*(?:import|from)\s+([A-Za-z_][\w.]*)", "[.]"))
    importing = t.rlike(r"(?:^|[^\x21-\x7e])(?:use|import|from)[^\x21-\x7e]")
    # a name stands as a whole where it is a run of word characters: those that are there once come from the sorted runs, not from a search for each name
    runs = F.sort_array(F.regexp_extract_all(t, F.lit(r"(?U)(\w+)"), 1))
    once = let(runs, lambda w: F.filter(w, lambda x, i: ~x.eqNullSafe(F.get(w, i - 1)) & ~x.eqNullSafe(F.get(w, i + 1))))
    odd = lambda found: F.size(F.filter(found, lambda x: x.contains(":") & (F.regexp_count(t, F.concat(F.lit(r"(?U)\b"), x, F.lit(r"\b"))) <= 1)))
    unused = let(imported, lambda found: F.when(F.size(found) > 0, (F.size(F.array_intersect(once, found)) + odd(found)) / F.size(found)).otherwise(0.0))
    unused = F.when(importing, unused).otherwise(0.0)
    tabs = F.when(t.contains("\n\t") & t.contains("\n    "), 0.4).otherwise(0.0)
    ends = F.when(t.contains("\r\n") & F.replace(t, F.lit("\r\n"), F.lit("")).contains("\n"), 0.3).otherwise(0.0)
    function = r"(?U)\b(?:def|fn)\s+"
    snake = F.exists(F.regexp_extract_all(t, F.lit("(?i)" + function + "([a-z][a-z0-9_]*)"), 1), lambda x: x.contains("_") | (F.lower(x) == x))
    camel = t.rlike(function + r"[a-z][A-Za-z0-9]*[A-Z]\w*")
    style = F.least(F.lit(1.0), tabs + ends + F.when(t.rlike("(?i)(?:def|fn)[^\\x21-\\x7e]") & snake & camel, 0.3).otherwise(0.0))
    found = {"placeholders": placeholders, "repeated_lines": repeated, "long_names": names, "unused_imports": unused, "mixed_style": style}
    blank = ~t.rlike(r"(?U)\S")
    found = {k: F.when(blank, 0.0).otherwise(v) for k, v in found.items()}
    score = sum((F.col(k) * w for k, w in AUTHORSHIP.items()), F.lit(0.0))
    return df.withColumns(found).withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


#: Definitions by language group; group 1 is the name.
DEFINITIONS = {
    "python": r"(?m)^[ \t]*(?:async[ \t]+)?(?:def|class)[ \t]+([A-Za-z_][A-Za-z0-9_]*)",
    "js": r"(?m)^[ \t]*(?:export[ \t]+)?(?:default[ \t]+)?(?:async[ \t]+)?(?:function|class)[ \t]+([A-Za-z_$][A-Za-z0-9_$]*)",
    "rust": r"(?m)^[ \t]*(?:pub(?:\([^)]*\))?[ \t]+)?(?:async[ \t]+)?(?:fn|struct|enum|trait)[ \t]+([A-Za-z_][A-Za-z0-9_]*)",
    "go": r"(?m)^(?:func(?:[ \t]*\([^)]*\))?|type)[ \t]+([A-Za-z_][A-Za-z0-9_]*)",
    "java": r"(?m)^[ \t]*(?:public|private|protected|static|final|abstract|[ \t])*(?:class|interface|enum)[ \t]+([A-Za-z_][A-Za-z0-9_]*)",
    "kotlin": r"(?m)^[ \t]*(?:(?:public|private|internal|open|data|override|suspend)[ \t]+)*(?:fun|class|object|interface)[ \t]+([A-Za-z_][A-Za-z0-9_]*)",
}


def definitions(text: Column, language: str) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(DEFINITIONS[language]), 1)


def lost_symbols(df: DataFrame, before: str, after: str, language: str) -> DataFrame:
    """Names that were defined before and are not after; nothing is lost from an empty text."""
    b, a = definitions(F.col(before), language), definitions(F.col(after), language)
    return df.withColumn("lost", F.array_sort(F.array_except(b, a))).withColumn("ok", F.size("lost") == 0)


def imports(lines: DataFrame) -> DataFrame:
    """``file, line, module`` of import lines, the top package only."""
    name = F.regexp_extract("text", r"^\s*(?:import|from)\s+([A-Za-z_]\w*)", 1)
    return lines.select("file", "line", name.alias("module")).filter("module <> ''")


def grep(lines: DataFrame, pattern: str, most: int = 100) -> DataFrame:
    """Matching lines in order, cut to 200 characters, at most so many (the feature's limit), and whether there are more."""
    hits = lines.filter(F.col("text").rlike("(?i)" + pattern)).select("file", "line", F.substring(F.trim("text"), 1, 200).alias("text"))
    first = hits.orderBy("file", "line").limit(most + 1)
    from pyspark.sql import Window as W

    return first.withColumn("_n", F.row_number().over(W.orderBy("file", "line"))).withColumn("truncated", F.max("_n").over(W.partitionBy()) > most).filter(F.col("_n") <= most).drop("_n")


def tokens_to_definitions(lines: DataFrame, names: DataFrame) -> DataFrame:
    """Per name: lines that mention it as a whole word but do not define it.  Lines are tokenised once and joined on the token."""
    token = lines.select("file", "line", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"([A-Za-z_][A-Za-z0-9_]*)"), 1))).alias("name"))
    used = token.join(names.select("name").distinct(), "name")
    return used.join(names.select("name", "file", "line").distinct(), ["name", "file", "line"], "left_anti").groupBy("name").agg(F.count("*").alias("references"))


def changed_lines(patch: Column) -> Column:
    """Numbers of the new file's lines that a unified diff of one file touches; a deletion marks the place of its gap."""
    rows = F.split(F.coalesce(patch, F.lit("")), "\n", -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        head = F.regexp_extract(x, r"^@@ -\d+(?:,\d+)? \+(\d+)", 1)
        skip = x.startswith("+++") | x.startswith("---") | (x == "")
        plus, minus = x.startswith("+"), x.startswith("-")
        at = F.when(head != "", F.try_to_number(head, F.lit("999999999")).cast("int")).when(skip | minus, s["at"]).otherwise(s["at"] + 1)
        out = F.when(~skip & (head == "") & (plus | minus) & (s["at"] > 0), F.array_append(s["out"], s["at"])).otherwise(s["out"])
        return F.struct(at.alias("at"), out.alias("out"))

    return F.array_distinct(F.aggregate(rows, start, step)["out"])


# Syntax that needs a newer version of Python, newest first.
NEWER_SYNTAX = (
    (312, r"(?m)^\s*type\s+[A-Za-z_]\w*\s*(\[[^\]\n]*\])?\s*="),
    (312, r"(?m)^\s*(?:async\s+)?def\s+[A-Za-z_]\w*\s*\["),
    (312, r"(?m)^\s*class\s+[A-Za-z_]\w*\s*\["),
    (311, r"(?m)^\s*except\*\s+"),
)
SYNTAX_CODES = ("E999", "invalid-syntax", "E902", "syntax")


def newer_syntax(text: Column) -> Column:
    """The version (100 times the major one and the minor one) that the newest syntax in a text needs; null if there is none."""
    return F.greatest(*[F.when(F.coalesce(text, F.lit("")).rlike(p), v) for v, p in NEWER_SYNTAX])


def split_by_version(findings: DataFrame, files: DataFrame, current: int, required: int | None = None) -> DataFrame:
    """findings with ``needs``: the version for which a syntax error is none, if that is newer than ours; null for findings to keep.

    The project's own required version counts first, then the syntax of the file's text (``file, text``).
    """
    syntax = (F.col("error_type") == "syntax") | F.col("code").isin(*SYNTAX_CODES)
    asked = files.select("file", newer_syntax(F.col("text")).alias("_needs"))
    if required is not None and required > current:
        asked = asked.withColumn("_needs", F.lit(required))
        return findings.withColumn("needs", F.when(F.coalesce(syntax, F.lit(False)), F.lit(required)))
    out = findings.join(asked.filter(F.col("_needs") > current), "file", "left")
    return out.withColumn("needs", F.when(F.coalesce(syntax, F.lit(False)), F.col("_needs"))).drop("_needs")


def segments(lines: DataFrame, most: int = 400) -> DataFrame:
    """``file, segment, start, end`` of each file: cut before the last line that opens a top-level block, so that no segment has more than most lines.

    lines: ``file, line, text``.  A file is read in order once; a segment without such a line is cut at its limit.
    """
    opens = F.col("text").rlike(r"^(?:async\s+def|def|class|@|fn|pub|impl|struct|enum|trait|mod|function|export|interface|func|type|public|private|protected|namespace|template)\b|^@")
    whole = lines.groupBy("file").agg(F.sort_array(F.collect_set(F.when(opens, F.col("line").cast("long")))).alias("at"), F.max("line").cast("long").alias("n"))
    kinds = dict(whole.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, at, n in zip(batch.column("file").to_pylist(), batch.column("at").to_pylist(), batch.column("n").to_pylist(), strict=True):
                ends = [(a, b) for a, b in _cut(at, n, most)]
                columns = [pa.array([k] * len(ends), batch.schema.field("file").type), pa.array(range(len(ends)), pa.int32()), *(pa.array(x, pa.int64()) for x in zip(*ends, strict=True))]
                yield pa.RecordBatch.from_arrays(columns, ["file", "segment", "start", "end"])

    return whole.mapInArrow(run, f"file {kinds['file']}, segment int, start long, end long")


def _cut(at: list[int], n: int, most: int) -> Iterator[tuple[int, int]]:
    """First and last lines of the segments of a file of n lines whose blocks begin ``at``; a block stays whole unless it is longer than most lines."""
    places = [1, *(x for x in at if x != 1)]
    lo = 1
    for line, following in zip(places, [*places[1:], n + 1], strict=True):
        if following - lo <= most:
            continue
        if line > lo:
            yield lo, line - 1
            lo = line
        while following - lo > most:
            yield lo, lo + most - 1
            lo += most
    yield lo, n


def braces(text: Column) -> Column:
    """Open less closed brackets of each kind ``round, square, curly``; strings and comments are not told apart."""
    t = F.coalesce(text, F.lit(""))
    count = lambda c: F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))
    return F.struct(*[(count(a) - count(b)).alias(n) for n, a, b in (("round", "(", ")"), ("square", "[", "]"), ("curly", "{", "}"))])
