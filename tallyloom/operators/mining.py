"""Mining of verified fixes: gates, recipes, training rows and preference pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyloom.functions.rules import infer_language
from tallyloom.operators.dedup import first_wins

# Fixed values.
SUPPRESSION = r"(?i)#\s*noqa|type:\s*ignore|#\s*nosec|eslint-disable|allow\(|@SuppressWarnings|pragma warning disable"
NON_CANONICAL = ("list-item", "arg-type", "assignment", "return-value")
MOST_LINES, LEAST_WINS = 12, 2


def _full(lines: Column) -> Column:
    return F.filter(F.coalesce(lines, F.array().cast("array<string>")), lambda x: F.trim(x) != "")


def gate(strict: bool = True) -> Column:
    """The first reason why a verification record is not to be harvested, or "ok".

    strict: also canonical codes and small snippets only, as recipes need them; training rows do not.
    """
    c = F.col
    before, after = _full(c("before_snippet")), _full(c("after_snippet"))
    adds = F.array_join("after_snippet", "\n").rlike(SUPPRESSION) & ~F.array_join("before_snippet", "\n").rlike(SUPPRESSION)
    rules = (
        F.when(~c("verdict").eqNullSafe("REAL_FIX"), "not_real_fix")
        .when(c("unsafe_accept").eqNullSafe(True), "unsafe_accept")
        .when(~c("strength").eqNullSafe("strong"), "not_strong")
        .when(F.size(F.coalesce("weak_markers", F.array().cast("array<string>"))) > 0, "weak_markers")
        .when(F.coalesce("suspicious", F.lit(0)) > 0, "semantic_suspicious")
        .when(F.trim(F.coalesce("code", F.lit(""))) == "", "no_code")
    )
    if strict:
        rules = rules.when(F.trim("code").isin(*NON_CANONICAL), "non_canonical_code").when((F.size(before) == 0) | (F.size(after) == 0), "empty_snippet").when(before == after, "no_change")
        rules = rules.when((F.size("before_snippet") > MOST_LINES) | (F.size("after_snippet") > MOST_LINES), "too_large")
    else:
        rules = rules.when((F.size(before) == 0) | (F.size(after) == 0) | (before == after), "no_change")
    return rules.when(adds, "adds_suppression").otherwise("ok")


def recipes(records: DataFrame) -> DataFrame:
    """Codes with two or more different verified changes that all share a word of three letters or more.

    A word is shared by all changes of a code if as many changes have it as there are: counting, not intersecting collected sets.
    """
    good = records.filter(gate() == "ok")
    change = F.sha2(F.concat_ws("\x01", F.array_join("before_snippet", "\n"), F.array_join("after_snippet", "\n")), 256)
    good = first_wins(good.withColumn("change", change), [F.col("code"), F.col("change")], ["seq"])
    wins = good.groupBy("code").agg(F.count("*").alias("wins"), F.min("seq").alias("first")).filter(F.col("wins") >= LEAST_WINS)
    words = good.select("code", "change", F.explode(F.array_distinct(F.regexp_extract_all(F.array_join("after_snippet", "\n"), F.lit(r"(\w{3,})"), 1))).alias("word"))
    shared = words.groupBy("code", "word").agg(F.count("*").alias("k")).join(wins, "code").filter(F.col("k") == F.col("wins"))
    return wins.join(shared.groupBy("code").agg(F.min("word").alias("word")), "code").select("code", "wins", "first", "word")


def clean_accept() -> Column:
    """Accepted, with a patch, target not known to remain, no known growth, no roll-back, no suppression."""
    c = F.col
    return (
        (F.upper(F.coalesce("decision", F.lit(""))) == "ACCEPT")
        & (F.coalesce("patch", F.lit("")) != "")
        & ~c("target_removed").eqNullSafe(False)
        & ~F.coalesce(c("net_delta") > 0, F.lit(False))
        & ~c("rollback_used").eqNullSafe(True)
        & ~F.coalesce("patch", F.lit("")).rlike(SUPPRESSION)
    )


def labels(verified: DataFrame, learned: DataFrame) -> DataFrame:
    """Training rows ``label, reason, language, code, source``: verified fixes and clean accepts are positive; unsafe, useless and rejected ones negative."""
    reason = gate(strict=False)
    before, after = _full(F.col("before_snippet")), _full(F.col("after_snippet"))
    changed = (F.size(before) > 0) & (F.size(after) > 0) & (before != after)
    from_verify = verified.withColumn("reason", F.when(reason == "ok", "verified_real_fix").when(F.col("unsafe_accept").eqNullSafe(True), "unsafe_symbol_loss").when(F.col("verdict").eqNullSafe("STILL_FLAGGED") & changed, "still_flagged_no_effect")).filter("reason IS NOT NULL")
    from_verify = from_verify.select(F.when(F.col("reason") == "verified_real_fix", "positive").otherwise("negative").alias("label"), "reason", infer_language(F.col("code"), F.col("language")).alias("language"), "code", F.lit("verify").alias("source"))
    rejected = F.upper(F.coalesce("decision", F.lit(""))) == "REJECT"
    from_learning = learned.filter(F.coalesce("patch", F.lit("")) != "").withColumn("_r", F.when(rejected, F.substring(F.coalesce(F.nullif("reason", F.lit("")), F.lit("reject")), 1, 80)).when(clean_accept(), "clean_accept_inpipeline")).filter("_r IS NOT NULL")
    from_learning = from_learning.select(F.when(rejected, "negative").otherwise("positive").alias("label"), F.col("_r").alias("reason"), infer_language(F.col("code"), F.col("language")).alias("language"), "code", F.lit("learning").alias("source"))
    return from_verify.unionByName(from_learning)


def preference_pairs(learned: DataFrame, key: list[str]) -> DataFrame:
    """Per finding: its first clean accepted patch and its first rejected one."""
    cols = [F.col(k) for k in key]
    chosen = first_wins(learned.filter(clean_accept()), cols, ["seq"]).select(*key, F.col("patch").alias("chosen"), F.col("seq").alias("chosen_seq"))
    rejected = learned.filter((F.upper(F.coalesce("decision", F.lit(""))) == "REJECT") & (F.coalesce("patch", F.lit("")) != ""))
    rejected = first_wins(rejected, cols, ["seq"]).select(*key, F.col("patch").alias("rejected"), F.col("seq").alias("rejected_seq"), F.substring(F.coalesce(F.nullif("reason", F.lit("")), F.lit("reject")), 1, 80).alias("rejected_reason"))
    return chosen.join(rejected, key)


def renames(df: DataFrame, key: list[str], removed: str, added: str) -> DataFrame:
    """Attributes that were replaced by ones equal but for case, or two edits away: of each change, removed-only against added-only names.

    The names of one change are few; the pairing never leaves its change.
    """
    old = df.select(*key, F.explode(F.array_except(removed, added)).alias("old"), F.array_except(added, removed).alias("_new"))
    pairs = old.select(*key, "old", F.explode("_new").alias("new"))
    far = F.levenshtein(F.lower("old"), F.lower("new"))
    case = F.lower("old") == F.lower("new")
    near = (F.abs(F.length("old") - F.length("new")) <= 2) & (far <= 2) & (F.least(F.length("old"), F.length("new")) >= 4)
    return pairs.filter(case | near).withColumns({"kind": F.when(case, "case_rename").otherwise("near_rename"), "distance": F.when(~case, far)})


def export_messages(rows: DataFrame) -> DataFrame:
    """One JSON line per positive row: a chat of request and fix."""
    ask = F.format_string("Fix %s in this %s code: %s", F.coalesce("code", F.lit("?")), F.coalesce("language", F.lit("unknown")), F.coalesce("message", F.lit("")))
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return rows.select(F.to_json(F.struct(F.array(turn("user", ask), turn("assistant", F.array_join("after_snippet", "\n"))).alias("messages"))).alias("value"))


def _rows(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\\r\\n|\\n|\\r", -1)


# What begins the lines of a patch that are no code.
PATCH_HEADERS = ("--- ", "+++ ", "diff --git", "index ", "rename ", "new file", "deleted file", "similarity ")


def after_text(patch: Column) -> Column:
    """The new text of a unified diff: from its first hunk on, context and added lines without their marks."""
    rows = _rows(patch)
    first = F.array_position(F.transform(rows, lambda x: x.startswith("@@")), True)
    head = lambda x: F.exists(F.array(*[F.lit(h) for h in PATCH_HEADERS]), lambda h: x.startswith(h))
    kept = F.filter(F.slice(rows, F.greatest(first, F.lit(1)).cast("int"), F.when(first > 0, F.size(rows)).otherwise(0)), lambda x: ~(head(x) | x.startswith("@@") | x.startswith("-")))
    text = F.array_join(F.transform(kept, lambda x: F.regexp_replace(x, "^[+ ]", "")), "\n")
    return F.regexp_replace(text, r"\A\n+|\n+\z", "")


def is_diff(text: Column) -> Column:
    begin = F.regexp_replace(text, r"\A\s+", "")
    return text.contains("@@") | text.contains("+++ b/") | begin.startswith("--- ") | begin.startswith("diff --git")


def prompt(code: Column, language: Column, message: Column, context: Column) -> Column:
    """What a model is asked: the finding and the lines around it."""
    given = lambda c, other: F.coalesce(F.when(c != "", c), F.lit(other))
    lines = F.array_join(F.coalesce(context, F.array().cast("array<string>")), "\n")
    return F.concat(F.lit("Language: "), given(language, "code"), F.lit("\nFinding: "), given(code, "?"), F.lit("\nMessage: "), given(message, ""), F.lit("\n\nCODE:\n"), lines, F.lit("\n\nProduce the fix."))


def target(after: Column, patch: Column) -> Column:
    """What a model is to answer: the lines after the fix, else the new text of the patch; empty if neither is plain code."""
    text = after_text(patch)
    plain = is_diff(patch) & (F.trim(text) != "") & ~is_diff(text) & ~text.startswith("a/")
    return F.when(F.size(_full(after)) > 0, F.array_join(after, "\n")).when(plain, text).otherwise("")
