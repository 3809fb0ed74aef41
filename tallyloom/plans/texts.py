"""Queries of line scanners, tool-output sources, sinks, and of streams and their batch twins."""

from pyspark.sql import functions as F

from tallyloom.functions.text import split_lines
from tallyloom.operators import scanners
from tallyloom.plans.adapters import SQL, decisions, doc_lines, findings, table, with_views
from tallyloom.plans.folders import shared_folder
from tallyloom.plans.registry import query
from tallyloom.sources import sinks, tools
from tallyloom.streaming import events as streaming

#: Source lines for every alternative of every rule, and near misses: each row of part picks one.
SNIPPETS = (
    'password = "hunter2hunter2"', "api_key = 'abc123def'", 'api_key = os.environ["KEY"]', "token = 'abc'", 'client_secret: str = "s3cr3t-value"', 'cfg.db_passwd = "abcdef"', 'name = "abcdefgh"', 'private-key = "abcdefgh"', 'auth_token = "a1b2c3d4" + os.getenv("X")',
    "value = eval(user_input)", "obj.eval(x)", "retrieval(x)", "exec (code)", "data = pickle.loads(blob)", "data = pickle.load(f)", "cfg = yaml.load(f)", "my.yaml.load(f)", "os.system(cmd)", "self.os.system(cmd)", "subprocess.run(c, shell = True)", "# os.system(cmd)",
    'cur.execute("SELECT * FROM t WHERE id=" + uid)', 'cur.execute("SELECT 1")', "cur.executemany('delete from t where id = %s' % x)", 'cur.execute(f"update t set a = {x}")', "cur.execute('insert into t'.format(x))", 'cur.execute("drop table t" + x)', 'cur.execute(sql + "where x")',
    "def load_all(x):", "class Reader:", "async def later():", "import os.path", "from sys import argv", "import json", "type Pair = int", "class Box[T]:", "def first[T](x: T):", "except* ValueError:", "match x:",
    'let token = "abcdef99";', "var apikey = 'abcdef';", "const pwd = `abcdef`;", "const user = 'abcdef';", "const secret = process.env.SECRET;", "eval(code)", "x = new Function (body)", "el.innerHTML = x;", "el.outerHTML == x", "document.write(x)", "el.insertAdjacentHTML('a', x)", 'const cp = require("child_process")', "exec('ls ' + x)", "execSync('ls')", "re.exec(a + b)", "// eval(x)", "* eval(x)",
    'let mut token: &str = "abcd";', 'let pwd = "abc";', 'let secret = std::env::var("A") + "abcd";', 'Command::new("sh")', 'Command::new("zsh")', 'Command::new("powershell")', 'Command::new("ls")', 'c.arg("-c")', "bincode::deserialize(&b)", "serde_pickle::from_slice(b)", 'query("x WHERE id = " + &id)', 'sqlx::query_as(&format!("SELECT {}", x))', 'q.push_str("a"); execute("DELETE")', 'query(AssertSqlSafe(format!("SELECT {}", x)))', 'batch_execute("SELECT 1")',
    'const string ApiKey = "abcd1234";', 'readonly string Token = "abc";', 'var password = Environment.GetEnvironmentVariable("P") ?? "abcd";', 'string secret = "abcd"; // IConfiguration', "var f = new BinaryFormatter();", "new LosFormatter()", "MyBinaryFormatters()", 'Process.Start("cmd " + arg);', "new ProcessStartInfo(String.Format(a, b))", 'Process.Start("ls")', 'new SqlCommand($"SELECT {x}")', 'cmd.CommandText = "DELETE FROM t WHERE a=" + a;', 'db.FromSqlRaw("SELECT 1")',
    "strcpy(dst, src);", "strncpy(dst, src, n); strcpy(a, b);", "my_gets(x)", "vsprintf (a, b);", "system(cmd.c_str());", "popen(a + b)", 'system("ls")', 'execvp(format("{}", a), b)', 'std::string token = "abcd";', 'const char* passwd = "abcd";', 'auto apikey = getenv("abcd") ? "a" : "abcd";',
    "pub fn load<T>(x: T) -> T {", "impl Reader {", "pub trait Shape {", "func (r Reader) Open(x int) {", "type Reader struct {", "public static void main(String args) {", "int add(int a, int b);", "const walk = async (x) => x;", "enum class Color { RED };", "interface Shape {", "fun area(x: Int) {",
)
#: Word characters of Unicode and what stands before a call, for DuckDB, which has no look-behind.
WORD, FREE = r"[\p{L}\p{M}\p{N}_]", r"(?:^|[^.\p{L}\p{M}\p{N}_])"


def snippets(spark, d):
    """``file, line, text``: the supplied part table as source lines."""
    lines = F.array(*[F.lit(s) for s in SNIPPETS])
    return table(spark, d, "part").select(F.concat(F.lit("f"), F.col("p_partkey") % 10).alias("file"), F.col("p_partkey").alias("line"), F.get(lines, (F.col("p_partkey") % len(SNIPPETS)).cast("int")).alias("text"))


def source_lines(spark, d):
    """``file, line, text``: the snippets, and every line of every document."""
    docs = doc_lines(spark, d).select(F.concat(F.lit("d"), "doc_id").alias("file"), F.col("line").cast("long").alias("line"), "text")
    return snippets(spark, d).unionByName(docs)


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _snippet_sql() -> str:
    cases = " ".join(f"WHEN {i} THEN {quoted(s)}" for i, s in enumerate(SNIPPETS))
    return f"sn AS (SELECT concat('f', p_partkey % 10) AS file, p_partkey::BIGINT AS line, CASE p_partkey % {len(SNIPPETS)} {cases} END AS text FROM part)"


def _lines_sql() -> str:
    """The snippets and all documents' lines, as sn."""
    return f"{_snippet_sql().replace('sn AS', 'sn0 AS', 1)}, doc_lines AS ({SQL['doc_lines']}), sn AS (SELECT * FROM sn0 UNION ALL SELECT concat('d', doc_id), line::BIGINT, text FROM doc_lines)"


def hit(pattern: str) -> str:
    return f"regexp_matches(text, {quoted(pattern)})"


def _secret_sql(declared: str, quotes: str, least: int, but: str) -> str:
    whole = declared + r"\s*=\s*(?:" + "|".join(f"{q}([^{q}]*){q}" for q in quotes) + ")"
    part = lambda i: f"regexp_extract(text, {quoted(whole)}, {i})"
    name = "(?i)secret|passwd|password|pwd|token|api[_-]?key|apikey|access[_-]?key|private[_-]?key|auth[_-]?token|client[_-]?secret"
    return f"regexp_matches({part(1)}, {quoted(name)}) AND length(concat({', '.join(part(i + 2) for i in range(len(quotes)))})) >= {least} AND NOT {hit(but)}"


ENV = r"(?i)os\.environ|os\.getenv|getenv|process\.env|std::env::var|dotenv|environ\["
QUERY = r"(?i)['\"].*\b(SELECT|INSERT|UPDATE|DELETE|FROM|WHERE)\b"
BUILT = hit(r'\$"|"\s*\+|\+\s*"|String\.Format')
#: The rules for DuckDB, written apart from the operator's.
FAMILY_SQL = {
    "python": {
        "hardcoded_secret": _secret_sql(r"^\s*([A-Za-z_][A-Za-z0-9_.]*)", "\"'", 6, ENV), "dangerous_eval": hit(FREE + r"(eval|exec)\s*\("), "unsafe_deserialization": hit(FREE + r"(yaml\.load|pickle\.load|pickle\.loads)\s*\("),
        "sql_injection": f"{hit(chr(92) + '.execute(many)?' + chr(92) + 's*' + chr(92) + '(')} AND {hit(QUERY)} AND ({hit('[+%]')} OR {hit('[.]format' + chr(92) + 's*[(]')} OR {hit('f[' + chr(39) + chr(34) + ']')})", "command_injection": f"({hit(FREE + 'os[.]system' + chr(92) + 's*[(]')} OR {hit('shell' + chr(92) + 's*=' + chr(92) + 's*True')})",
    },
    "js": {
        "hardcoded_secret": _secret_sql(r"(?:const|let|var)\s+([A-Za-z0-9_$]+)", "\"'`", 6, ENV), "dangerous_eval": hit(FREE + r"eval\s*\(|new\s+Function\s*\("),
        "xss": hit(r"\.(inner|outer)HTML\s*=([^=]|$)|document\.write\s*\(|\.insertAdjacentHTML\s*\("), "command_injection": hit("child_process|" + FREE + r"exec(Sync)?\s*\([^)]*\+"),
    },
    "rust": {
        "hardcoded_secret": _secret_sql(r"let\s+(?:mut\s+)?([A-Za-z0-9_]+)\s*(?::\s*&?[A-Za-z0-9_]+\s*)?", '"', 4, ENV), "command_injection": hit(r'Command::new\s*\(\s*"(sh|bash|zsh|cmd|powershell)"\s*\)|\.arg\s*\(\s*"-c"\s*\)'),
        "unsafe_deserialization": hit("serde_pickle|bincode::deserialize"), "sql_injection": f"{hit(r'\b(query|query_as|query_scalar|execute|sql_query|batch_execute)\s*\(')} AND {hit(QUERY)} AND {hit(r'format!\s*\(|\+\s*&|\.push_str\s*\(|"\s*\+')} AND NOT contains(text, 'AssertSqlSafe')",
    },
    "csharp": {
        "hardcoded_secret": _secret_sql(r"(?:const\s+string|readonly\s+string|string|var)\s+([A-Za-z0-9_]+)", '"', 4, ENV) + " AND NOT contains(text, 'GetEnvironmentVariable') AND NOT contains(text, 'IConfiguration')",
        "sql_injection": f"{hit(r'\b(SqlCommand|CommandText|OleDbCommand|MySqlCommand|NpgsqlCommand|FromSqlRaw|ExecuteSqlRaw)\b')} AND {hit(QUERY.replace('[', '[$', 1))} AND {BUILT}", "command_injection": f"{hit(r'\b(Process\.Start|ProcessStartInfo)\b')} AND {BUILT}",
        "unsafe_deserialization": hit(r"\b(BinaryFormatter|NetDataContractSerializer|LosFormatter|SoapFormatter|ObjectStateFormatter)\b"),
    },
    "cpp": {
        "hardcoded_secret": _secret_sql(r"(?:const\s+)?(?:char\s*\*|std::string|auto|string)\s+([A-Za-z0-9_]+)", '"', 4, "getenv"), "command_injection": f"{hit(r'\b(system|popen|_popen|execlp|execvp)\s*\(')} AND {hit(r'\+|\.c_str\s*\(\)|printf|format')}".replace("printf", "sprintf|snprintf"),
        "buffer_overflow": f"{hit(r'\b(strcpy|strcat|sprintf|gets|vsprintf|scanf)\s*\(')} AND NOT {hit(r'\b(strncpy|strncat|snprintf|vsnprintf|fgets)\b')}",
    },
}
COMMENTS = {"python": "^\\s*#", "rust": "^\\s*//"}


def _hits(family: str) -> str:
    cases = ", ".join(f"CASE WHEN {test} THEN '{name}' END" for name, test in FAMILY_SQL[family].items())
    return f"WITH {_lines_sql()}, h AS (SELECT file, line, length(text) - length(regexp_replace(text, '^\\s+', '')) + 1 AS col, unnest([{cases}]) AS code FROM sn WHERE NOT {hit(COMMENTS.get(family, '^' + chr(92) + 's*(//|[*]|/[*])'))})"


@query("x1_security_scan", _hits("python") + " SELECT file, line, col, code FROM h WHERE code IS NOT NULL")
def x1(spark, d):
    return scanners.security_scan(source_lines(spark, d), "python").select("file", "line", "col", "code")


def _rules(family):
    def run(spark, d):
        return scanners.security_scan(source_lines(spark, d), family).groupBy("code").agg(F.count("*").alias("n"))

    return run


for _family in FAMILY_SQL:
    if _family != "python":
        query(f"x2_rules_{_family}", _hits(_family) + " SELECT code, count(*) AS n FROM h WHERE code IS NOT NULL GROUP BY code")(_rules(_family))


def _source_texts(spark, d):
    """``file, text``: the documents, and the snippets of each file as one text."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n")
    return snippets(spark, d).groupBy("file").agg(joined.alias("text")).unionByName(table(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("file"), "text"))


AUTHORSHIP_SQL = f"""WITH {_snippet_sql()}, t AS (SELECT file, string_agg(text, chr(10) ORDER BY line) AS text FROM sn GROUP BY file UNION ALL SELECT concat('d', doc_id), coalesce(text, '') FROM documents),
l AS (SELECT file, text, CASE WHEN suffix(text, chr(10)) OR text = '' THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END AS ls FROM t),
r AS (SELECT file, max(k) AS best FROM (SELECT file, v, count(*) AS k FROM (SELECT file, regexp_replace(unnest(ls), '^\\s+|\\s+$', '', 'g') AS v FROM l) WHERE length(v) >= 10 AND NOT regexp_matches(v, '^(#|//|/\\*|\\*)') GROUP BY 1, 2) GROUP BY file),
i AS (SELECT file, text, list_concat([string_split(x, '::')[-1] FOR x IN regexp_extract_all(text, '(?m)^\\s*use\\s+([A-Za-z_][\\w:]*)', 1)], [string_split(x, '.')[-1] FOR x IN regexp_extract_all(text, '(?m)^\\s*(?:import|from)\\s+([A-Za-z_][\\w.]*)', 1)]) AS names FROM t),
u AS (SELECT file, count(*) FILTER (WHERE name <> '' AND len(regexp_extract_all(text, concat('\\b', name, '\\b'))) <= 1) / count(*) AS unused FROM (SELECT file, text, unnest(names) AS name FROM i) GROUP BY file),
f AS (SELECT l.file, least(1.0, len([x FOR x IN ls IF regexp_matches(x, '(?i)\\b(TODO|FIXME|XXX|HACK|implementation\\s+here|your\\s+code\\s+here|add\\s+(logic|implementation|code)\\s+here|placeholder|\\.\\.\\.|unimplemented!)\\b')]) / greatest(1, len(ls)) * 10) AS placeholders,
 CASE WHEN coalesce(best, 0) < 3 THEN 0.0 ELSE least(1.0, (best - 2) / 6) END AS repeated_lines, least(1.0, len(list_distinct(regexp_extract_all(text, '\\b[A-Za-z_][A-Za-z0-9_]{{34,}}\\b'))) / 5) AS long_names, coalesce(unused, 0.0) AS unused_imports,
 CASE WHEN contains(text, chr(10) || chr(9)) AND contains(text, chr(10) || '    ') THEN 0.4 ELSE 0.0 END + CASE WHEN contains(text, chr(13) || chr(10)) AND contains(replace(text, chr(13) || chr(10), ''), chr(10)) THEN 0.3 ELSE 0.0 END
 + CASE WHEN len([x FOR x IN regexp_extract_all(text, '(?i)\\b(?:def|fn)\\s+([a-z][a-z0-9_]*)', 1) IF contains(x, '_') OR lower(x) = x]) > 0 AND regexp_matches(text, '\\b(def|fn)\\s+[a-z][A-Za-z0-9]*[A-Z]\\w*') THEN 0.3 ELSE 0.0 END AS mixed_style
 FROM l LEFT JOIN r ON r.file = l.file LEFT JOIN u ON u.file = l.file)
SELECT file, round(placeholders, 9)::DOUBLE AS placeholders, round(repeated_lines, 9)::DOUBLE AS repeated_lines, round(long_names, 9)::DOUBLE AS long_names, round(unused_imports, 9)::DOUBLE AS unused_imports, round(mixed_style, 9)::DOUBLE AS mixed_style,
 round(0.3 * placeholders + 0.2 * repeated_lines + 0.15 * long_names + 0.15 * unused_imports + 0.2 * mixed_style, 9)::DOUBLE AS score FROM f"""


@query("x4_authorship", AUTHORSHIP_SQL)
def x4(spark, d):
    return scanners.authorship(_source_texts(spark, d)).select("file", *[F.round(c, 9).alias(c) for c in (*scanners.AUTHORSHIP, "score")])


TEXT = "+t AS (SELECT file, string_agg(text, chr(10) ORDER BY line) AS before, string_agg(CASE WHEN line % 3 <> 0 THEN text END, chr(10) ORDER BY line) AS after FROM sn GROUP BY file)"


def _texts(spark, d, dealt=lambda lines: lines):
    s = dealt(source_lines(spark, d))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("line", "text")))), lambda x: x["text"]), "\n")
    return s.groupBy("file").agg(joined(F.lit(True)).alias("before"), joined(F.col("line") % 3 != 0).alias("after"))


@query("u6_lost_symbols", f"WITH {_lines_sql()}, {TEXT[1:]} SELECT file, len([x FOR x IN list_distinct(regexp_extract_all(before, '(?m)^[ \\t]*(?:async[ \\t]+)?(?:def|class)[ \\t]+([A-Za-z_][A-Za-z0-9_]*)', 1)) IF NOT list_contains(regexp_extract_all(after, '(?m)^[ \\t]*(?:async[ \\t]+)?(?:def|class)[ \\t]+([A-Za-z_][A-Za-z0-9_]*)', 1), x)]) AS lost FROM t")
def u6(spark, d):
    return scanners.lost_symbols(_texts(spark, d), "before", "after", "python").select("file", F.size("lost").cast("long").alias("lost"))


@query("x5_symbols", f"WITH {_lines_sql()}, {TEXT[1:]} SELECT file, len(regexp_extract_all(before, '(?m)^[ \\t]*(?:async[ \\t]+)?(?:def|class)[ \\t]+([A-Za-z_][A-Za-z0-9_]*)', 1)) AS names FROM t")
def x5(spark, d):
    return _texts(spark, d).select("file", F.size(scanners.definitions(F.col("before"), "python")).cast("long").alias("names"))


@query("a19_symbol_counts", f"WITH {_lines_sql()} SELECT file, name, count(*) AS before, count(*) FILTER (WHERE line % 3 <> 0) AS after FROM (SELECT file, line, regexp_extract(text, '^[ \\t]*(?:async[ \\t]+)?(?:def|class)[ \\t]+([A-Za-z_][A-Za-z0-9_]*)', 1) AS name FROM sn) WHERE name <> '' GROUP BY 1, 2")
def a19(spark, d):
    name = F.get(scanners.definitions(F.col("text"), "python"), F.lit(0))
    return source_lines(spark, d).select("file", "line", name.alias("name")).filter("name IS NOT NULL").groupBy("file", "name").agg(F.count("*").alias("before"), F.count_if(F.col("line") % 3 != 0).alias("after"))


@query("a20_marker_counts", "SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[0-9]+')) AS numbers, len(regexp_extract_all(coalesce(text, ''), '\\bthe\\b')) AS marks FROM documents")
def a20(spark, d):
    t = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").select("doc_id", F.regexp_count(t, F.lit("[0-9]+")).cast("long").alias("numbers"), F.regexp_count(t, F.lit(r"(?<![\w\u0080-\uffff])the(?![\w\u0080-\uffff])")).cast("long").alias("marks"))


@query("x10_imports", f"WITH {_lines_sql()} SELECT file, module, count(*) AS n FROM (SELECT file, regexp_extract(text, '^\\s*(?:import|from)\\s+([A-Za-z_]\\w*)', 1) AS module FROM sn) WHERE module <> '' GROUP BY 1, 2")
def x10(spark, d):
    return scanners.imports(source_lines(spark, d)).groupBy("file", "module").agg(F.count("*").alias("n"))


@query("j10_references", f"WITH {_lines_sql()}, tok AS (SELECT DISTINCT file, line, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) AS name FROM sn) SELECT name, count(*) AS \"references\" FROM tok WHERE name IN ('os', 'eval', 'cmd') AND NOT (name = 'os' AND file = 'f2') GROUP BY name")
def j10(spark, d):
    s = source_lines(spark, d)
    names = s.filter("file = 'f2'").select(F.lit("os").alias("name"), "file", "line").unionByName(s.select(F.lit("eval").alias("name"), F.lit("-").alias("file"), "line")).unionByName(s.select(F.lit("cmd").alias("name"), F.lit("-").alias("file"), "line"))
    return scanners.tokens_to_definitions(s, names)


@query("x12_segments")
def x12(spark, d):
    return scanners.segments(source_lines(spark, d), 40)


NEEDS = "greatest(" + ", ".join(f"CASE WHEN regexp_matches(text, {quoted(p)}) THEN {v} END" for v, p in scanners.NEWER_SYNTAX) + ")"


@query("x15_newer_syntax", f"WITH {_lines_sql()}, t AS (SELECT file, string_agg(text, chr(10) ORDER BY line) AS text FROM sn GROUP BY file) SELECT file, {NEEDS} AS needs FROM t")
def x15(spark, d):
    return _source_texts(spark, d).select("file", scanners.newer_syntax(F.col("text")).alias("needs"))


@query("x16_braces", "SELECT doc_id, " + ", ".join(f"length(coalesce(text, '')) - length(replace(coalesce(text, ''), '{a}', '')) - (length(coalesce(text, '')) - length(replace(coalesce(text, ''), '{b}', ''))) AS {n}" for n, a, b in (("round", "(", ")"), ("square", "[", "]"), ("curly", "{", "}"))) + " FROM documents")
def x16(spark, d):
    b = table(spark, d, "documents").select("doc_id", scanners.braces(F.col("text")).alias("b")).select("doc_id", "b.*")
    return b.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("round", "square", "curly")])


@query("f14_grep", with_views("doc_lines", body="SELECT doc_id, line, substr(trim(text), 1, 200) AS text FROM doc_lines WHERE regexp_matches(text, '(?i)token =') ORDER BY doc_id, line LIMIT 100"))
def f14(spark, d):
    rows = doc_lines(spark, d).withColumnRenamed("doc_id", "file")
    return scanners.grep(rows, "token =").select(F.col("file").alias("doc_id"), "line", "text")


#: Findings' files with the texts of the snippets' files, dealt by module.
FILES = "fs AS (SELECT DISTINCT file, concat('f', length(file) * 7 % 10) AS of FROM findings)"


@query("f1_version_filter", with_views("findings", body=f"+{FILES}, {_snippet_sql()}, t AS (SELECT file, string_agg(text, chr(10) ORDER BY line) AS text FROM sn GROUP BY file), n AS (SELECT fs.file, {NEEDS} AS needs FROM fs JOIN t ON t.file = fs.of) SELECT seq, CASE WHEN (error_type = 'syntax' OR code IN ('E999', 'invalid-syntax', 'E902', 'syntax')) AND n.needs > 310 THEN n.needs END AS needs FROM findings f LEFT JOIN n ON n.file = f.file"))
def f1(spark, d):
    f = findings(spark, d)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n")
    texts = snippets(spark, d).groupBy(F.col("file").alias("of")).agg(joined.alias("text"))
    files = f.select("file", F.concat(F.lit("f"), F.length("file") * 7 % 10).alias("of")).distinct().join(texts, "of").select("file", "text")
    return scanners.split_by_version(f, files, 310).select("seq", "needs")


@query("p16_changed_lines", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN [p_size + 1, p_size + 2, p_size + 4] ELSE [p_size, p_size + 1, p_size + 70] END::INT[] AS lines FROM part")
def p16(spark, d):
    n = lambda k: (F.col("p_size") + k).cast("string")
    head = lambda k: F.concat(F.lit("@@ -9,4 +"), n(k), F.lit(",5 @@\n"))
    one = F.concat(F.lit("--- a/x.py\n+++ b/x.py\n"), head(0), F.lit(" ctx\n+one\n+two\n ctx\n-gone\n ctx"))
    two = F.concat(F.lit("--- a/x.py\n+++ b/x.py\n"), head(0), F.lit("-old\n+new\n+more\n ctx\n"), head(70), F.lit("+last\n ctx"))
    patch = F.when(F.col("p_size") % 2 == 0, one).otherwise(two)
    return table(spark, d, "part").select("p_partkey", scanners.changed_lines(patch).alias("lines"))


@query("p33_synthetic_codes", with_views("findings", body="SELECT CASE seq % 6 WHEN 0 THEN 'GCC_SEMI' WHEN 1 THEN 'GCC_BRACE' WHEN 2 THEN 'GCC_REDEFINITION' WHEN 3 THEN 'GCC_SYNTAX' WHEN 4 THEN 'GCC_PAREN' ELSE '' END AS code, count(*) AS n FROM findings GROUP BY 1"))
def p33(spark, d):
    from tallyloom.functions.rules import synthetic_code

    message = F.element_at(F.array(*[F.lit(x) for x in ("Expected ';'", "expected '}' at end", "redefinition of x", "unterminated string", "expected ')'", "fine")]), (F.col("seq") % 6 + 1).cast("int"))
    return findings(spark, d).groupBy(synthetic_code(message).alias("code")).agg(F.count("*").alias("n"))


@query("split_lines", "SELECT doc_id, len(string_split(coalesce(text, ''), chr(10))) - (CASE WHEN text IS NULL OR text = '' OR suffix(text, chr(10)) THEN 1 ELSE 0 END) AS n FROM documents")
def lines(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(split_lines(F.col("text"))).cast("long").alias("n"))


# --- sources: findings are written in a tool's format and read back ---

SOURCE = {
    "flake8": "concat(file, ':', line, ':', col, ': E', seq % 900 + 100, ' ', 'bad thing')",
    "mypy": "concat(file, ':', line, ': error: bad thing [arg-type]')",
    "gcc": "concat(file, ':', line, ':', col, ': error: bad thing [-Wall]')",
    "dotnet": "concat(file, '(', line, ',', col, '): error CS', seq % 900 + 1000, ': bad thing [x.csproj]')",
    "tsc": "concat(file, '(', line, ',', col, '): error TS', seq % 900 + 1000, ': bad thing')",
    "javac": "concat(file, '.java:', line, ': error: bad thing')",
    "go": "concat(file, '.go:', line, ':', col, ': bad thing')",
    "kotlin": "concat('e: ', file, '.kt:', line, ':', col, ' bad thing')",
    "rustc": "concat('  --> ', file, ':', line, ':', col)",
}
SUFFIX = {"javac": ".java", "go": ".go", "kotlin": ".kt"}


def _source(tool):
    def run(spark, d):
        raw = findings(spark, d).selectExpr(f"CASE WHEN seq % 9 = 0 THEN 'note: nothing here' ELSE {SOURCE[tool]} END AS value")
        return tools.parse_text(raw, tool).groupBy("file", "severity").agg(F.count("*").alias("n"), F.sum("line").alias("lines"))

    return run


for _tool in SOURCE:
    _severity = "warning" if _tool in ("go", "kotlin", "rustc") else "error"
    query(f"s_{_tool}", with_views("findings", body=f"SELECT concat(file, '{SUFFIX.get(_tool, '')}') AS file, '{_severity}' AS severity, count(*) AS n, sum(line) AS lines FROM findings WHERE seq % 9 <> 0 GROUP BY file"))(_source(_tool))


@query("s5_ruff", with_views("findings", body="SELECT file, code, count(*) AS n, sum(line) AS lines FROM findings GROUP BY 1, 2"))
def s5(spark, d):
    doc = F.to_json(F.array(F.struct(F.col("file").alias("filename"), "code", "message", F.struct(F.col("line").alias("row"), F.col("col").alias("column")).alias("location"))))
    return tools.parse_json(findings(spark, d).select(doc.alias("value")), "ruff").groupBy("file", "code").agg(F.count("*").alias("n"), F.sum("line").alias("lines"))


@query("s6_bandit", with_views("findings", body="SELECT file, 'high' AS severity, count(*) AS n FROM findings GROUP BY 1"))
def s6(spark, d):
    doc = F.to_json(F.struct(F.array(F.struct(F.col("file").alias("filename"), F.col("line").alias("line_number"), F.col("code").alias("test_id"), F.col("message").alias("issue_text"), F.lit("HIGH").alias("issue_severity"))).alias("results")))
    return tools.parse_json(findings(spark, d).select(doc.alias("value")), "bandit").groupBy("file", "severity").agg(F.count("*").alias("n"))


@query("s7_semgrep", with_views("findings", body="SELECT file, count(*) AS n, sum(line) AS lines FROM findings WHERE file NOT LIKE 'src/m7/%' GROUP BY 1"))
def s7(spark, d):
    doc = F.to_json(F.struct(F.array(F.struct(F.col("file").alias("path"), F.col("code").alias("check_id"), F.struct("line", "col").alias("start"), F.struct("message", "severity").alias("extra"))).alias("results")))
    rows = tools.parse_json(findings(spark, d).select(doc.alias("value")), "semgrep")
    return rows.filter(~F.col("file").startswith("src/m7/")).groupBy("file").agg(F.count("*").alias("n"), F.sum("line").alias("lines"))


@query("s11_eslint", with_views("findings", body="SELECT file, CASE WHEN seq % 2 = 0 THEN 'error' ELSE 'warning' END AS severity, count(*) AS n FROM findings GROUP BY 1, 2"))
def s11(spark, d):
    doc = F.to_json(F.array(F.struct(F.col("file").alias("filePath"), F.array(F.struct(F.col("code").alias("ruleId"), "line", F.col("col").alias("column"), "message", (2 - F.col("seq") % 2).alias("severity"))).alias("messages"))))
    return tools.parse_json(findings(spark, d).select(doc.alias("value")), "eslint").groupBy("file", "severity").agg(F.count("*").alias("n"))


@query("s15_pip_audit", "SELECT concat('CVE-', p_partkey) AS code, concat(p_name, ' 1.', p_size, ' bad') AS message FROM part")
def s15(spark, d):
    doc = F.to_json(F.struct(F.array(F.struct(F.col("p_name").alias("name"), F.concat(F.lit("1."), "p_size").alias("version"), F.array(F.struct(F.concat(F.lit("CVE-"), "p_partkey").alias("id"), F.lit("bad").alias("description"))).alias("vulns"))).alias("dependencies")))
    return tools.parse_json(table(spark, d, "part").select(doc.alias("value")), "pip_audit").select("code", "message")


@query("s18_last_rows", with_views("decisions", body="SELECT seq, decision FROM decisions ORDER BY seq DESC LIMIT 50"))
def s18(spark, d):
    return tools.last_rows(decisions(spark, d).select("seq", "decision"), 50, "seq")


@query("s21_applied_log", with_views("decisions", body="SELECT file, count(*) AS n, sum(line) AS lines FROM decisions WHERE decision = 'ACCEPT' GROUP BY file"))
def s21(spark, d):
    line = F.when(F.col("decision") == "ACCEPT", F.concat(F.lit("12:00 [applied] {'file': '"), "file", F.lit("', 'line': "), "line", F.lit(", 'code': '"), "code", F.lit("'}"))).otherwise("idle")
    return tools.applied_events(decisions(spark, d).select(line.alias("value"))).groupBy("file").agg(F.count("*").alias("n"), F.sum("line").alias("lines"))


@query("s3_python_syntax")
def s3(spark, d):
    return tools.python_syntax(_source_texts(spark, d)).groupBy("file", "code").agg(F.count("*").alias("n"))


@query("s14_sanitizer")
def s14(spark, d):
    rows = snippets(spark, d).withColumn("k", F.floor(F.col("line") / 10) % 5)
    text = F.when(F.col("k") == 0, "==12==ERROR: AddressSanitizer: heap-buffer-overflow on address").when(F.col("k") == 1, "    #0 0xab in memcpy /usr/lib/x.c:9").when(F.col("k") == 2, F.concat(F.lit("    #1 0xab in main src/a.c:"), F.col("line").cast("string"))).otherwise("  padding")
    return tools.sanitizer_findings(rows.select("file", F.col("line").alias("n"), text.alias("text")))


# --- sinks ---


@query("k3_redact", with_views("decisions", body="SELECT seq, '<redacted>' AS token, file AS path FROM decisions"))
def k3(spark, d):
    m = sinks.redact(F.create_map(F.lit("api_token"), F.lit("x"), F.lit("path"), F.col("file")))
    return decisions(spark, d).select("seq", m["api_token"].alias("token"), m["path"].alias("path"))


@query("k6_snapshots", with_views("decisions", body="SELECT file, arg_min(reason, seq) AS before, arg_max(decision, seq) AS after, count(*) AS changes FROM decisions GROUP BY file"))
def k6(spark, d):
    return sinks.snapshots(decisions(spark, d).select("file", "seq", F.col("reason").alias("before"), F.col("decision").alias("after")))


@query("k8_merge_events", with_views("decisions", body="SELECT coalesce(CASE WHEN seq % 2 = 0 THEN project END, 'all') AS project_id, count(*) AS n FROM decisions WHERE seq > 0 GROUP BY 1"))
def k8(spark, d):
    rows = decisions(spark, d).select(F.when(F.col("seq") == 0, "schema").otherwise("patch_event").alias("_type"), F.when(F.col("seq") % 2 == 0, F.col("project")).alias("project_id"))
    return sinks.merge_events(rows, "all").groupBy("project_id").agg(F.count("*").alias("n"))


# --- streams, run to their end over the supplied events ---


def _drain(spark, d, build, mode):
    """Run a streaming plan over the events table once and return the result: each batch is written to the shared folder, the last rows of a plan that repeats itself are those of its last batch."""
    out = shared_folder(spark, "stream-results")
    source = spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "events*.parquet").parquet(d)
    q = build(source.withColumn("ts", F.col("ts").cast("timestamp"))).writeStream.outputMode(mode).option("checkpointLocation", shared_folder(spark, "streams")).trigger(availableNow=True).foreachBatch(lambda rows, batch: rows.write.mode("overwrite").parquet(f"{out}/batch={batch}")).start()
    q.awaitTermination()
    rows = spark.read.parquet(out)
    return (rows.filter(F.col("batch") == rows.agg(F.max("batch")).first()[0]) if mode == "complete" else rows).drop("batch")


@query("t_windowed_counts", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def t_windows(spark, d):
    out = _drain(spark, d, lambda e: streaming.windowed_counts(e), "complete")
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", F.round("total", 6).alias("total"))


@query("t2_once", "SELECT user_id, event_type, count(*) > 0 AS seen FROM events GROUP BY 1, 2")
def t_once(spark, d):
    return _drain(spark, d, lambda e: streaming.once(e, ["user_id", "event_type"], "365 days"), "append").select("user_id", "event_type", F.lit(True).alias("seen"))


@query("t4_attempts", """WITH e AS (SELECT concat('u', user_id) AS file, event_id AS seq, CASE WHEN event_type = 'error' THEN 'x' WHEN event_type = 'view' THEN 'y' ELSE '' END AS reason FROM events), f AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY seq) - row_number() OVER (PARTITION BY file, reason ORDER BY seq) AS g FROM e WHERE reason <> ''), s AS (SELECT file, max(k) >= 3 AS blocked FROM (SELECT file, row_number() OVER (PARTITION BY file, reason, g ORDER BY seq) AS k FROM f) GROUP BY file)
SELECT c.file, c.attempts, coalesce(s.blocked, false) AS blocked FROM (SELECT file, count(*) AS attempts FROM e GROUP BY file) c LEFT JOIN s ON s.file = c.file""")
def t_attempts(spark, d):
    def build(e):
        rows = e.select(F.concat(F.lit("u"), "user_id").alias("file"), F.lit("h").alias("file_hash"), F.when(F.col("event_type") == "error", "x").when(F.col("event_type") == "view", "y").otherwise("").alias("reason"), F.col("event_id").alias("seq"))
        return streaming.attempts(rows)

    out = _drain(spark, d, build, "update")
    return out.groupBy("file").agg(F.max("attempts").alias("attempts"), F.max_by("blocked", "attempts").alias("blocked"))


@query("t5_expire", "SELECT count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 7 DAYS")
def t_expire(spark, d):
    rows = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return streaming.expire(rows, "ts", "2024-01-30 00:00:00", 7).agg(F.count("*").alias("n"))


@query("s17_project_tree", with_views("findings", body="+p AS (SELECT DISTINCT file FROM findings) SELECT 'src' AS path, 'folder' AS kind, 0 AS depth UNION ALL SELECT DISTINCT regexp_extract(file, '^(src/[^/]*)/', 1), 'folder', 1 FROM p UNION ALL SELECT file, 'file', 2 FROM p"))
def s17(spark, d):
    return tools.project_tree(findings(spark, d).select("file").distinct()).select("path", "kind", "depth")


@query("t3_append_log", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def t_append(spark, d):
    """An append-only log, run twice with one checkpoint: the second run takes up where the first ended, so nothing is there twice."""
    out, at = shared_folder(spark, "log"), shared_folder(spark, "log-checkpoint")
    for _ in range(2):
        source = spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "events*.parquet").parquet(d)
        streaming.append_log(source, out, at).awaitTermination()
    return spark.read.parquet(out).groupBy("event_type").agg(F.count("*").alias("n"))


@query("t1_dispatch", "SELECT event_type AS listener, count(*) AS n FROM events WHERE event_type IN ('error', 'view') GROUP BY 1")
def t_dispatch(spark, d):
    """Listeners of a bus; one of them always fails, and the others go on."""
    out = shared_folder(spark, "bus")

    def broken(rows):
        raise ValueError("listener")

    listeners = {"broken": broken, "error": lambda e: e.filter("event_type = 'error'"), "view": lambda e: e.filter("event_type = 'view'")}
    source = spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "events*.parquet").parquet(d)
    streaming.dispatch(source, listeners, out, shared_folder(spark, "bus-checkpoint")).awaitTermination()
    return spark.read.option("recursiveFileLookup", True).parquet(f"{out}/error", f"{out}/view").groupBy(F.col("event_type").alias("listener")).agg(F.count("*").alias("n"))
