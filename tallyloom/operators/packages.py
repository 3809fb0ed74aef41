"""Packages that source code uses but its manifest does not list: crates of Rust, and packages found by a prefix of what is imported.

All tables may hold many projects: ``by`` names the columns that tell them apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

# Roots of paths that are no crates, attributes of the language, shapes of lines, crates with version and
# features, what a derived trait or an attribute needs.
NOT_CRATES = ("crate", "self", "super", "std", "core", "alloc", "Self")
OWN_ATTRIBUTES = (
    "derive", "cfg", "cfg_attr", "allow", "warn", "deny", "forbid", "test", "ignore", "should_panic", "inline", "repr", "doc", "non_exhaustive", "must_use", "deprecated", "macro_use", "macro_export", "path", "no_std",
    "no_mangle", "used", "link", "global_allocator", "panic_handler", "automatically_derived", "track_caller", "cold", "proc_macro", "proc_macro_derive", "proc_macro_attribute",
)
USE = r"^\s*(?:pub\s+(?:\([^)]*\)\s+)?)?use\s+(?:::)?([A-Za-z_][A-Za-z0-9_]*)"
MODULE = r"^\s*(?:pub\s+(?:\([^)]*\)\s+)?)?mod\s+([A-Za-z_][A-Za-z0-9_]*)\s*[;{]"
EXTERN = r"^\s*(?:pub\s+)?extern\s+crate\s+([A-Za-z_][A-Za-z0-9_]*)"
PATH = r"\b([a-z_][a-z0-9_]*)::"
DERIVE = r"#\[\s*derive\s*\(([^)]*)\)\s*\]"
ATTRIBUTE = r"#\[\s*([a-z_][a-z0-9_]*)\b"
NAME = "([A-Za-z_][A-Za-z0-9_]*)"
CRATES = (
    ("serde", "1", ()), ("serde_json", "1", ()), ("serde_yaml", "0.9", ()), ("tokio", "1", ("full",)), ("clap", "4", ()), ("anyhow", "1", ()), ("thiserror", "1", ()), ("rand", "0.8", ()),
    ("regex", "1", ()), ("log", "0.4", ()), ("env_logger", "0.11", ()), ("tracing", "0.1", ()), ("tracing_subscriber", "0.3", ()), ("chrono", "0.4", ()), ("reqwest", "0.11", ()), ("futures", "0.3", ()),
    ("lazy_static", "1", ()), ("once_cell", "1", ()), ("itertools", "0.12", ()), ("uuid", "1", ()), ("bytes", "1", ()), ("async_trait", "0.1", ()), ("num_cpus", "1", ()), ("rayon", "1", ()),
)
DERIVED = {"Serialize": ("serde", "derive"), "Deserialize": ("serde", "derive"), "Parser": ("clap", "derive"), "Subcommand": ("clap", "derive"), "Args": ("clap", "derive"), "ValueEnum": ("clap", "derive"), "Error": ("thiserror", None)}
ATTRIBUTED = ("serde", "tokio", "clap", "async_trait")


def _named(kind: str, names: Column) -> Column:
    return F.transform(names, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("name")))


def _one(text: Column, pattern: str) -> Column:
    return F.array(F.regexp_extract(text, pattern, 1))


def rust_names(lines: DataFrame, by: list[str] = (), text: str = "text", file: str = "file") -> DataFrame:
    """``by, kind, name``, each once.  Kinds: used, hidden (brought in from the crate itself or the standard library), module, derived, attribute."""
    t = F.substring_index(F.coalesce(F.col(text), F.lit("")), "//", 1)
    use = F.regexp_extract(t, USE, 1)
    body = F.substring_index(F.regexp_extract(t, r"use([\s\S]*)$", 1), ";", 1)
    hidden = F.when(use.isin(*NOT_CRATES), F.regexp_extract_all(body, F.lit(NAME), 1)).otherwise(F.array().cast("array<string>"))
    derived = F.transform(F.flatten(F.transform(F.regexp_extract_all(t, F.lit(DERIVE), 1), lambda x: F.split(x, ","))), lambda x: F.trim(x))
    stem, folder = F.regexp_extract(file, r"([^/]*)\.rs$", 1), F.regexp_extract(file, r"([^/]*)/mod\.rs$", 1)
    own = F.array(F.when(stem.isin("main", "lib", "mod"), F.lit("")).otherwise(stem), folder, F.regexp_extract(t, MODULE, 1))
    found = F.concat(
        _named("used", F.concat(F.array(use), _one(t, EXTERN), F.regexp_extract_all(t, F.lit(PATH), 1))), _named("hidden", hidden), _named("module", own), _named("derived", derived),
        _named("attribute", F.filter(F.regexp_extract_all(t, F.lit(ATTRIBUTE), 1), lambda x: ~x.isin(*OWN_ATTRIBUTES))),
    )
    return lines.select(*by, F.explode(F.filter(found, lambda x: x["name"] != "")).alias("_x")).select(*by, "_x.*").distinct()


def rust_manifest(lines: DataFrame, by: list[str] = (), line: str = "line", text: str = "text") -> DataFrame:
    """``by, name`` of the dependencies in lines of Cargo.toml files, with _ for -."""
    t = F.trim(text)
    head = F.when(t.startswith("[") & t.endswith("]"), F.trim(F.expr(f"substring(trim({text}), 2, length(trim({text})) - 2)")))
    part = F.last(head, ignorenulls=True).over(W.partitionBy(*by).orderBy(line).rowsBetween(W.unboundedPreceding, 0))
    name = F.regexp_extract(t, r"^([A-Za-z0-9_\-]+)\s*[.=]", 1)
    rows = lines.select(*by, part.alias("_part"), head.alias("_head"), F.translate(name, "-", "_").alias("name"))
    return rows.filter("_head IS NULL AND _part LIKE '%dependencies' AND name <> ''").select(*by, "name").distinct()


def missing_crates(names: DataFrame, listed: DataFrame, by: list[str] = ()) -> DataFrame:
    """``by, name, version, features``: crates that are needed, known and not listed; version is null for those that are not known.

    names: as of ``rust_names``; listed: as of ``rust_manifest``.  The tables of crates are constants, so their sides are small.
    """
    spark, by = names.sparkSession, list(by)
    of = lambda *kinds: names.filter(F.col("kind").isin(*kinds)).select(*by, "name")
    used = of("used").filter(~F.col("name").isin(*NOT_CRATES)).join(of("module", "hidden").distinct(), [*by, "name"], "left_anti").withColumn("feature", F.lit(None).cast("string"))
    traits = spark.createDataFrame([(t, c, f) for t, (c, f) in DERIVED.items()], "trait string, crate string, feature string")
    derived = of("derived").join(F.broadcast(traits), F.col("name") == F.col("trait")).select(*by, F.col("crate").alias("name"), "feature")
    known = [c for c, _, _ in CRATES]
    attributed = of("attribute").filter(F.col("name").isin(*ATTRIBUTED, *known)).withColumn("feature", F.lit(None).cast("string"))
    needed = used.unionByName(derived).unionByName(attributed).withColumn("name", F.translate("name", "-", "_"))
    needed = needed.groupBy(*by, "name").agg(F.array_sort(F.collect_set("feature")).alias("_more")).join(listed.select(*by, "name").distinct(), [*by, "name"], "left_anti")
    crates = spark.createDataFrame([(c, v, list(f)) for c, v, f in CRATES], "name string, version string, _base array<string>")
    features = F.array_join(F.array_union("_base", "_more"), ",")
    return needed.join(F.broadcast(crates), "name", "left").select(*by, "name", "version", F.when(F.col("version").isNotNull(), features).alias("features"))


def missing_by_prefix(names: DataFrame, listed: DataFrame, table: DataFrame, by: list[str] = (), mark: str = ".") -> DataFrame:
    """``by, package, via``: packages that the table gives for the longest prefix of a name and that are not listed; via is the first such name.

    names: ``by, name`` (imports, includes); table: ``prefix, package``; listed: ``by, name``, in any case of letters; mark: what parts names.
    """
    by = list(by)
    parts = F.split("name", "[" + mark + "]")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), mark))
    hits = names.select(*by, "name").distinct().select(*by, "name", F.posexplode(prefixes).alias("_n", "prefix")).join(table.select("prefix", "package"), "prefix")
    best = hits.groupBy(*by, "name").agg(F.max_by("package", "_n").alias("package"))
    there = listed.select(*by, F.lower("name").alias("_key")).distinct()
    return best.withColumn("_key", F.lower("package")).join(there, [*by, "_key"], "left_anti").groupBy(*by, "package").agg(F.min("name").alias("via"))
