"""Classification, weights and confidence of findings as Column expressions, and the fixed values they use."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Classes, keywords and weights that results depend on.
CLASS_WEIGHTS = {"CRITICAL_SYNTAX": 200.0, "BLOCKING": 100.0, "SECURITY": 90.0, "STRUCTURAL": 70.0, "TEST_FAILURE": 60.0, "SEMANTIC_MISMATCH": 55.0, "CLEANUP": 30.0, "WARNING": 10.0, "UNKNOWN": 50.0, "BUILD_SCRIPT": 150.0, "MANIFEST": 200.0}
CLEANUP_WORDS = ("unused", "dead code", "never used", "unused import", "unused variable", "unused function", "function is never used")
CRITICAL_WORDS = ("unclosed", "unterminated", "double quote", "expected ';'", "expected token", "expected one of", "expected '('", "expected ')'", "expected '{'", "expected '}'", "expected expression", "could not parse", "unexpected token", "unexpected end of file", "missing `fn`", "missing `struct`", "unclosed delimiter", "unexpected closing delimiter")
FALLBACK_WORDS = ("unclosed", "unterminated", "double quote", "expected ';'", "expected token", "expected one of", "expected '('", "expected ')'", "expected '{'", "expected '}'", "expected expression", "could not parse", "unexpected token", "unexpected end of file", "unknown prefix")
TYPE_MULTIPLIERS = {"syntax": 1.2, "compile": 1.2, "type": 1.1, "dependency": 1.0, "runtime": 0.9, "security": 2.0, "lint": 0.3, "warning": 0.2, "info": 0.05, "unknown": 0.8}
CONFIDENCE_DECAY = {"security": 3.0, "compile": 2.5, "syntax": 2.5, "type": 2.0, "dependency": 1.5, "runtime": 1.5, "lint": 1.0, "warning": 0.8, "info": 0.5, "unknown": 1.8}
SOURCE_CONFIDENCE = {"quote_heuristic": 0.95, "brace_heuristic": 0.95, "splice_recovery": 0.95, "golden": 0.95, "memory": 0.9, "correctr": 0.85, "semantic_repair": 0.85, "type_ignore": 0.9, "structured_llm": 0.7, "structured_llm_blocking": 0.7, "rustc_suggestion": 0.7, "llm": 0.6, "llm_critical": 0.6, "llm_segmented": 0.6}
SEVERITY_WEIGHT = {"critical": 100.0, "error": 10.0, "warning": 1.0, "info": 0.0}
NON_BLOCKING_CODES = ("unused_imports", "unused_variables", "unused_mut", "dead_code", "clippy", "RUSTSEC")
NON_BLOCKING_WORDS = ("unused import", "unused variable", "unused mut", "dead code", "never used", "= note:", "= help:")
NON_BLOCKING_STARTS = ("warning:", "help:", "note:")
MISSING_DEPENDENCY = ("E0432", "E0433", "CS0246", "CS0234", "CS0103", "CS1061", "JAVAC_PACKAGE", "JAVAC_SYMBOL", "GCC_INCLUDE", "GCC_UNDECLARED", "TS2304", "TS2307", "TS2552", "F401", "F821", "E0401", "ModuleNotFoundError", "NameError", "no-undef")
STRUCTURAL_CODES = ("E999", "E902", "invalid-syntax")
NON_LIVE = ("tests/", "test/", "testing/", ".github/", "docs/", "examples/")
PROTECTED_NAMES = ("Cargo.toml", "package.json", "requirements.txt", ".env", "manage.py", "main.rs", "lib.rs")
PROTECTED_FOLDERS = ("migrations", "auth", "config")


def any_of(text: Column, words) -> Column:
    """Whether text has one of the words."""
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def lookup(key: Column, values: dict, default) -> Column:
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def base_name(path: Column) -> Column:
    return F.element_at(F.split(F.translate(path, "\\", "/"), "/"), -1)


def classify(file: Column, code: Column, level: Column, message: Column, provider_class: Column | None = None) -> Column:
    """Class of a finding by the first rule that holds: file name, warning level, clean-up words, lint code, the
    language's own code table (provider_class, null if it has none), unknown prefix, syntax words, security codes."""
    code, level, low = F.coalesce(code, F.lit("")), F.lower(F.coalesce(level, F.lit(""))), F.lower(F.coalesce(message, F.lit("")))
    name = base_name(F.coalesce(file, F.lit("")))
    rules = F.when(name == "build.rs", "BUILD_SCRIPT").when(name == "Cargo.toml", "MANIFEST").when(level == "warning", "CLEANUP").when(any_of(low, CLEANUP_WORDS), "CLEANUP").when(code.startswith("clippy::"), "CLEANUP")
    if provider_class is not None:
        rules = rules.when(provider_class.isNotNull(), provider_class)
    rules = rules.when(low.contains("prefix") & low.contains("unknown"), "CRITICAL_SYNTAX").when(any_of(low, CRITICAL_WORDS), "CRITICAL_SYNTAX")
    return rules.when(any_of(F.lower(code), (".security.", ".audit.", "security.audit")), "SECURITY").otherwise("UNKNOWN")


def class_weight(error_class: Column) -> Column:
    return lookup(error_class, CLASS_WEIGHTS, 50.0)


def fallback_class(message: Column) -> Column:
    return F.when(any_of(F.lower(message), FALLBACK_WORDS), "CRITICAL_SYNTAX").otherwise("UNKNOWN")


def keep_class(old: Column, new: Column) -> Column:
    """An existing strong class stays unless the new one is strong too."""
    strong = ("SECURITY", "BLOCKING", "CRITICAL_SYNTAX", "BUILD_SCRIPT", "MANIFEST")
    return F.when(old.isin(*strong) & ~new.isin(*strong), old).otherwise(new)


def model_weight(base: Column, error_type: Column, confidence: Column, scale: float = 100.0) -> Column:
    """scale * tanh(base * exp(-k (1 - confidence)) * multiplier / scale); types are looked up as written, others take k = 2 and multiplier 1."""
    c = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(confidence, F.lit(1.0))))
    b = F.greatest(F.lit(0.0), F.coalesce(base, F.lit(1.0)))
    t = F.coalesce(error_type, F.lit(""))
    raw = b * F.exp(-lookup(t, CONFIDENCE_DECAY, 2.0) * (1 - c)) * lookup(t, TYPE_MULTIPLIERS, 1.0)
    return scale * F.tanh(raw / scale)


def source_confidence(source: Column) -> Column:
    s = F.trim(F.coalesce(source, F.lit("")))
    return F.when(s.isin(*SOURCE_CONFIDENCE), lookup(s, SOURCE_CONFIDENCE, 0.5)).when(s.startswith("llm_blocking_"), 0.6).otherwise(0.5)


def non_blocking(code: Column, message: Column) -> Column:
    code, low = F.coalesce(code, F.lit("")), F.lower(F.coalesce(message, F.lit("")))
    starts = F.lit(False)
    for w in NON_BLOCKING_STARTS:
        starts = starts | F.ltrim(low).startswith(w)
    return code.isin(*NON_BLOCKING_CODES) | code.startswith("clippy") | starts | any_of(low, NON_BLOCKING_WORDS)


def protected(file: Column) -> Column:
    parts = F.split(F.translate(file, "\\", "/"), "/")
    return F.arrays_overlap(parts, F.array(*[F.lit(x) for x in (*PROTECTED_NAMES, *PROTECTED_FOLDERS)]))


def live(file: Column) -> Column:
    """Not below one of the folders for tests, documents or examples; leading dots and slashes do not count."""
    p = F.regexp_replace(F.translate(F.coalesce(file, F.lit("")), "\\", "/"), r"^[./]+", "")
    out = p != ""
    for m in NON_LIVE:
        bare = m.lstrip(".")
        out = out & ~p.startswith(m) & (p != m.rstrip("/")) if bare == m else out & ~p.startswith(m)
    return out


def infer_language(code: Column, given: Column) -> Column:
    g, c = F.lower(F.coalesce(given, F.lit(""))), F.trim(F.coalesce(code, F.lit("")))
    # Code families by language, in the order in which they are tried.
    mypy = ("attr-defined", "arg-type", "name-defined", "call-arg", "return-value", "assignment", "import-not-found", "list-item", "index", "union-attr", "var-annotated", "no-redef", "misc", "valid-type", "type-var")
    return (
        F.when(g != "", g)
        .when(c.rlike(r"^(CS|CA|IDE|SA|SX|IDISP)[0-9]"), "csharp")
        .when(c.rlike(r"^(cppcheck::|bugprone-|clang-|GCC_|modernize-|readability-|performance-|misc-|cppcoreguidelines-)"), "cpp")
        .when(c.rlike(r"^(clippy::|RUSTSEC)"), "rust")
        .when(c.rlike(r"^(E|W|F|C|B|D|N|S|T|A|I)[0-9]"), "python")
        .when(c.isin(*mypy), "python")
        .when(c.startswith("python."), "python")
        .when(c.rlike(r"^(yaml\.|html\.|package_managers\.)"), "config")
    )


# Analyzer codes that are noise, and what the other codes mean.
NOISE_CODES = ("CA1002", "CA1014", "CA1031", "CA1051", "CA1062", "CA1063", "CA1303", "CA1304", "CA1305", "CA1307", "CA1310", "CA1311", "CA1515", "CA1707", "CA1710", "CA1711", "CA1716", "CA1720", "CA1724", "CA1725", "CA1727", "CA1801", "CA1805", "CA1812", "CA1816", "CA1822", "CA1848", "CA1852", "CA2007", "CA5394")
NOISE_PREFIX = "^(IDE|SA|SX)[0-9]+$"
BUILD_NOISE, BUILD_NOISE_PER_FILE = ("GCC_UNDECLARED", "GCC_SYNTAX", "GCC_INCLUDE"), 8


def noise(code: Column) -> Column:
    code = F.coalesce(code, F.lit(""))
    return code.isin(*NOISE_CODES) | code.rlike(NOISE_PREFIX)


def synthetic_code(message: Column) -> Column:
    """A code for compiler messages that have none; empty if they fit no pattern."""
    m = F.lower(F.coalesce(message, F.lit("")))
    # Parts of messages and their codes, in the order in which they are tried.
    return (
        F.when(any_of(m, ("expected ';'", "missing terminating")), "GCC_SEMI")
        .when(any_of(m, ("expected '}'", "expected '{'")), "GCC_BRACE")
        .when(any_of(m, ("expected ')'", "expected '('")), "GCC_PAREN")
        .when(m.contains("no such file"), "GCC_INCLUDE")
        .when(any_of(m, ("was not declared", "undeclared")), "GCC_UNDECLARED")
        .when(m.contains("redefinition"), "GCC_REDEFINITION")
        .when(any_of(m, ("expected unqualified-id", "expected primary-expression", "expected expression", "unterminated", "unclosed")), "GCC_SYNTAX")
        .otherwise("")
    )


# Families of codes, and patterns of messages with the code and type that stand for them; the first that fits counts.
RUFF_TYPES = {
    "ASYNC": "lint", "SIM": "lint", "COM": "lint", "TCH": "lint", "RUF": "lint", "PLE": "compile", "PLR": "lint", "PLW": "warning", "PL": "lint", "UP": "lint", "C4": "lint",
    "B": "compile", "S": "security", "F": "lint", "I": "lint", "N": "lint", "E": "compile", "W": "warning", "D": "lint", "T": "lint", "Q": "lint", "A": "lint",
}
CSHARP_SYNTAX = ("CS1001", "CS1002", "CS1003", "CS1004", "CS1010", "CS1011", "CS1012", "CS1013", "CS1014", "CS1019", "CS1020", "CS1023", "CS1024", "CS1026", "CS1027", "CS1031", "CS1037", "CS1513", "CS1519", "CS1525")
CSHARP_DEPENDENCY = ("CS0006", "CS0234", "CS0246")
CSHARP_TYPE = ("CS0019", "CS0029", "CS0030", "CS0103", "CS0118", "CS0120", "CS0122", "CS0123", "CS0161", "CS0165", "CS0177", "CS0266", "CS1061", "CS1503", "CS1729")
CSHARP_NULLABLE = ("CS8600", "CS8601", "CS8602", "CS8603", "CS8604", "CS8605", "CS8607", "CS8608", "CS8609", "CS8610", "CS8614", "CS8618", "CS8619", "CS8620", "CS8625", "CS8629", "CS8631", "CS8634")
CSHARP_FAMILIES = {"CA": "lint", "IDE": "style", "IDISP": "resource", "SA": "style", "SX": "style", "RCS": "lint", "AD": "lint", "ASYNC": "concurrency", "ASP": "lint", "NU": "dependency", "VSTHRD": "concurrency", "S": "lint"}
MESSAGES = {
    "go": (
        (r"(?i)syntax error: unexpected", "GO_SYNTAX", "syntax"), ("missing return at end of function", "GO_RETURN", "control"), (r"expected (?:\{|\}|\(|\))", "GO_SYNTAX", "syntax"), ("undefined:", "GO_UNDEFINED", "resolve"), ("imported and not used", "GO_UNUSED_IMP", "warning"),
        (r"no required module provides|cannot find module|could not import|package .* is not in (?:GOROOT|std)", "GO_IMPORT", "dependency"), ("cannot use .* as .* in", "GO_TYPES", "type"), ("too many arguments|not enough arguments", "GO_ARGS", "type"), ("invalid operation", "GO_OPERAND", "type"),
        ("cannot convert", "GO_TYPES", "type"), ("declared (?:but )?not used", "GO_UNUSED_VAR", "warning"), ("shadows declaration", "GO_SHADOW", "warning"), ("possible misuse of unsafe.Pointer", "GO_UNSAFE", "warning"), ("", "GO_UNKNOWN", "unknown"),
    ),
    "javac": (
        ("';' expected", "JAVAC_SEMI", "syntax"), (r"'\}' expected|class, interface, .* expected", "JAVAC_BRACE", "syntax"), (r"'\)' expected|'\(' expected", "JAVAC_PAREN", "syntax"), ("reached end of file while parsing", "JAVAC_EOF", "syntax"), ("illegal start of (?:expression|type)", "JAVAC_SYNTAX", "syntax"),
        ("cannot find symbol", "JAVAC_SYMBOL", "resolve"), ("package .* does not exist", "JAVAC_PACKAGE", "dependency"), ("incompatible types", "JAVAC_TYPES", "type"), ("bad operand types", "JAVAC_OPERAND", "type"), ("missing return statement", "JAVAC_RETURN", "control"),
        ("variable .* might not have been initialized", "JAVAC_UNINIT", "control"), (r"\[unchecked\]", "JAVAC_UNCHECKED", "warning"), (r"\[deprecation\]", "JAVAC_DEPRECATED", "warning"), ("", "JAVAC_UNKNOWN", "unknown"),
    ),
    "kotlin": (
        ("unresolved reference", "KT_UNRESOLVED", "resolve"), ("cannot resolve symbol|cannot access", "KT_UNRESOLVED", "resolve"), ("type mismatch", "KT_TYPES", "type"), ("argument type mismatch", "KT_TYPES", "type"), ("no value passed for parameter", "KT_ARGS", "type"), ("too many arguments", "KT_ARGS", "type"),
        (r"only safe \(\?\.\) or non-null", "KT_NULLSAFE", "null_safety"), ("null can not be a value", "KT_NULLSAFE", "null_safety"), (r"expecting (?:'\}'|'\)'|'\{'|'\('|';'|an expression)", "KT_SYNTAX", "syntax"), ("syntax error", "KT_SYNTAX", "syntax"), (r"parameter '\w+' is never used", "KT_UNUSED_PARAM", "warning"),
        (r"variable '\w+' is never used", "KT_UNUSED_VAR", "warning"), ("unused expression", "KT_UNUSED_EXPR", "warning"), ("deprecated", "KT_DEPRECATED", "warning"), ("a 'return' expression required", "KT_RETURN", "control"), ("", "KT_UNKNOWN", "unknown"),
    ),
}
WEAK_MARKERS = {"any_type": r"\bAny\b", "type_ignore_comment": r"#\s*type:\s*ignore", "cast_any": r"\bcast\s*\(\s*Any\b", "return_object": r"->\s*object\b", "noqa_suppress": r"#\s*noqa\b"}
CHECK_LINE = r"^\s*(?:assert\b|if\s)"
ERODIBLE = ("import-untyped", "import-not-found", "untyped-decorator")


def message_class(tool: str, message: Column) -> Column:
    """Struct of the code and type that stand for a compiler's message."""
    found = None
    for pattern, code, kind in MESSAGES[tool]:
        value = F.struct(F.lit(code).alias("code"), F.lit(kind).alias("type"))
        found = (F if found is None else found).when(F.coalesce(message, F.lit("")).rlike(pattern), value)
    return found


def fix_strength(removed: Column, added: Column, code: Column) -> Column:
    """Struct of strength, markers and category of a fix by its removed and added lines: weak if it gives up types, or drops checks for none."""
    text = F.array_join(added, "\n")
    given_up = [F.when(text.rlike(p), F.lit(name)) for name, p in WEAK_MARKERS.items()]
    check = lambda lines: F.exists(lines, lambda x: x.rlike(CHECK_LINE))
    markers = F.array_compact(F.array(*given_up, F.when(check(removed) & ~check(added), F.lit("removed_check_without_replacement"))))
    weak = F.size(markers) > 0
    category = F.when(weak & F.coalesce(code, F.lit("")).isin(*ERODIBLE), "by_design").when(weak, "concerning")
    return F.struct(F.when(weak, "weak").otherwise("strong").alias("strength"), markers.alias("weak_markers"), category.alias("weak_category"))


def finding_type(tool: str, code: Column, message: Column) -> Column:
    """Type of a tool's finding by its code, or by the message where the code does not tell."""
    code, m = F.coalesce(code, F.lit("")), F.lower(F.coalesce(message, F.lit("")))
    # Codes and parts of messages by type, tool by tool.
    if tool == "flake8":
        named = F.when(any_of(m, ("undefined", "name")), "runtime").when(m.contains("import"), "dependency").otherwise("lint")
        return F.when(code.startswith("E999"), "syntax").when(code.startswith("E"), "compile").when(code.startswith("W"), "warning").when(code.startswith("F"), named).otherwise("lint")
    if tool == "rustc":
        known = {"E0277": "trait_not_satisfied", "E0425": "unresolved_function", "E0599": "unresolved_method", "E0382": "ownership_error", "E0596": "mutability_error", "E0594": "mutability_error"}
        mismatch = F.when(any_of(m, ("argument", "parameter")), "type_mismatch_argument").otherwise("type_mismatch")
        return F.when(code == "E0308", mismatch).when(code.isin(*known), lookup(code, known, "unknown")).when(code.startswith("E04"), "dependency").when(code.startswith("E03"), "type").when(code.startswith("E05"), "compile").otherwise("unknown")
    if tool == "gcc":
        return F.when(code.isin("GCC_SEMI", "GCC_BRACE", "GCC_PAREN", "GCC_SYNTAX", "C2143", "C2059"), "syntax").when(code.isin("GCC_INCLUDE", "C1083"), "dependency").when(code.isin("GCC_UNDECLARED", "GCC_REDEFINITION", "C2065"), "compile").otherwise("unknown")
    if tool == "tsc":
        n = F.regexp_replace(code, "^TS", "")
        return F.when(n.isin("1003", "1005", "1011", "1013", "1109", "1128", "1130", "1131", "1135", "1136", "1138", "1144"), "syntax").when(n == "2307", "dependency").when(n.isin("2304", "2552"), "resolve").when(n.isin("2322", "2339", "2345", "2358", "2367", "2532", "2769"), "type").when(n.isin("6133", "6196", "7006", "7053"), "warning").otherwise("unknown")
    if tool == "mypy":
        return F.when(m.contains("is not defined"), "resolve").when(m.contains("has no attribute"), "type").when(any_of(m, ("cannot find module", "cannot find implementation")), "dependency").when(m.contains("unreachable"), "warning").otherwise("type")
    if tool in MESSAGES:
        return message_class(tool, message)["type"]
    if tool == "ruff":
        return lookup(F.regexp_extract(code, r"^([\p{L}]*)", 1), RUFF_TYPES, "lint")
    if tool == "dotnet":
        family = lookup(F.regexp_extract(code, r"^(.*?)\d+$", 1), CSHARP_FAMILIES, "")
        bracket = m.contains("expected") & any_of(m, ("'{'", "'}'", "'('", "')'", "';'"))
        known = F.when(code.isin(*CSHARP_SYNTAX), "syntax").when(code.isin(*CSHARP_DEPENDENCY), "dependency").when(code.isin(*CSHARP_NULLABLE), "nullable").when(code.isin(*CSHARP_TYPE), "type").when(family != "", family)
        said = known.when(bracket, "syntax").when(any_of(m, ("does not exist", "could not be found")), "dependency").when(any_of(m, ("cannot convert", "no overload", "does not contain a definition")), "type")
        return said.when(code.startswith("CS0"), "compile").otherwise("unknown")
    raise ValueError(f"no types for {tool}")
