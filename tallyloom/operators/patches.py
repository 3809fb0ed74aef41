"""Patches of several files, and codes of findings that come without one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tallyloom.functions.text import slashes, split_lines

# What the kinds of sanitizer reports are called; the first that a kind contains counts.
SANITIZER_CODES = {
    "heap-buffer-overflow": "SAN_HEAP_OVERFLOW", "stack-buffer-overflow": "SAN_STACK_OVERFLOW", "global-buffer-overflow": "SAN_GLOBAL_OVERFLOW", "heap-use-after-free": "SAN_USE_AFTER_FREE",
    "use-after-poison": "SAN_USE_AFTER_POISON", "double-free": "SAN_DOUBLE_FREE", "alloc-dealloc-mismatch": "SAN_ALLOC_MISMATCH", "new-delete-type-mismatch": "SAN_NEW_DELETE_MISMATCH",
    "memory leaks": "SAN_MEMORY_LEAK", "direct leak": "SAN_DIRECT_LEAK", "indirect leak": "SAN_INDIRECT_LEAK", "use-of-uninitialized-value": "SAN_UNINIT",
    "data race": "SAN_DATA_RACE", "thread leak": "SAN_THREAD_LEAK", "lock-order-inversion": "SAN_LOCK_ORDER",
}
# Codes of messages of a type checker that have none.
MESSAGE_CODES = {"cannot find implementation or library stub": "import-untyped", "library stub file not found": "import-untyped", "untyped decorator makes function": "untyped-decorator"}


def changed_lines(patches: DataFrame) -> DataFrame:
    """Distinct ``id, line``: lines of the new file that a patch touches in the sections of its file; a deletion marks the place of its gap.

    patches: ``id, patch, file``.  A section is meant if its path or the file is the end of the other, by whole names.  Hunks are
    told by their heads, so a section may have any number, and the lines of a patch are numbered by running sums, not one by one.
    """
    rows = patches.select("id", slashes(F.col("file")).alias("file"), F.posexplode(split_lines(F.col("patch"))).alias("at", "raw")).filter("file <> ''")
    old, new = F.startswith("raw", F.lit("--- ")), F.startswith("raw", F.lit("+++ "))
    rows = rows.withColumn("_part", F.sum((old | new).cast("int")).over(W.partitionBy("id").orderBy("at")))
    path = slashes(F.regexp_replace(F.trim(F.substring("raw", 5, 2**30)), "^b/", ""))
    ends = lambda a, b: F.endswith(a, F.concat(F.lit("/"), b))
    meant = F.when(new, (path == F.col("file")) | ends(path, F.col("file")) | ends(F.col("file"), path))
    rows = rows.withColumn("_meant", F.max(meant).over(W.partitionBy("id", "_part"))).filter("_meant")
    head = F.regexp_extract("raw", r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,\d+)? @@", 1)
    rows = rows.withColumn("_head", F.when(head != "", F.try_to_number(head, F.lit("999999999")).cast("long")))
    part = W.partitionBy("id", "_part").orderBy("at")
    rows = rows.withColumn("_hunk", F.count("_head").over(part))
    inside = W.partitionBy("id", "_part", "_hunk").orderBy("at")
    plain = F.col("_head").isNull() & ~(F.startswith("raw", F.lit("+++")) | F.startswith("raw", F.lit("---")))
    minus = F.startswith("raw", F.lit("-"))
    begin = F.coalesce(F.first("_head", ignorenulls=True).over(inside), F.lit(0))
    line = begin + F.coalesce(F.sum((plain & ~minus).cast("int")).over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("line", line)
    return rows.filter(plain & (F.startswith("raw", F.lit("+")) | (minus & (F.col("line") > 0)))).select("id", "line").distinct()


def sanitizer_code(kind: Column) -> Column:
    """The code of a sanitizer's kind of report; others are their own names."""
    low, out = F.lower(F.trim(kind)), F.concat(F.lit("SAN_"), F.upper(F.btrim(F.regexp_replace(kind, "[^A-Za-z0-9]+", "_"), F.lit("_"))))
    for key, code in reversed(SANITIZER_CODES.items()):
        out = F.when(F.contains(low, F.lit(key)), code).otherwise(out)
    return out


def message_code(message: Column) -> Column:
    """The code of a type checker's message without one; empty for most."""
    low, out = F.lower(F.coalesce(message, F.lit(""))), F.lit("")
    for key, code in reversed(MESSAGE_CODES.items()):
        out = F.when(F.contains(low, F.lit(key)), code).otherwise(out)
    return out
