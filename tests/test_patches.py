"""Changed lines of several files against a plain walk over a patch; codes by their tables."""

import random
import re

from pyspark.sql import functions as F

from tallyloom.operators import patches, stats


def walk(patch, file):
    want, inside, at, out = file.replace("\\", "/").lstrip("/"), False, 0, set()
    for raw in patch.split("\n"):
        if raw[:4] in ("--- ", "+++ "):
            name = re.sub("^b/", "", raw[4:].strip()).lstrip("/")
            inside, at = raw[0] == "+" and (name == want or name.endswith("/" + want) or want.endswith("/" + name)), 0
        elif inside and (m := re.match(r"@@ -\d+(,\d+)? \+(\d+)(,\d+)? @@", raw)):
            at = int(m[2])
        elif inside and not raw.startswith(("+++", "---")):
            if raw.startswith("+") or raw.startswith("-") and at > 0:
                out.add(at)
            at += not raw.startswith("-")
    return out


def test_changed_lines(spark):
    rng, rows = random.Random(12), []
    for i in range(200):
        out = []
        for _ in range(rng.randrange(1, 4)):
            name = rng.choice(["a.py", "src/a.py", "lib/src/a.py", "b.py", "/dev/null"])
            out += [f"--- a/{name}", f"+++ b/{name}"]
            for _ in range(rng.randrange(0, 3)):
                out += [rng.choice(["@@ -1,2 +{} @@", "@@ -1 +{},7 @@ def f", "@@ odd +{} @@"]).format(rng.randrange(1, 90))]
                out += [rng.choice(["+new", "-old", " ctx", "+++x", "---", "\\ No newline", "-", "+", "\tx"]) for _ in range(rng.randrange(0, 8))]
        rows.append((i, "\n".join(out), rng.choice(["a.py", "src/a.py", "/x/lib/src/a.py", "src\\a.py", "c.py", "py", ""])))
    rows += [(900, None, "a.py"), (901, "+x", None), (902, "", "a.py")]
    found = patches.changed_lines(spark.createDataFrame(rows, "id long, patch string, file string").repartition(4))
    got = {}
    for r in found.collect():
        got.setdefault(r.id, set()).add(r.line)
    assert got == {i: s for i, p, f in rows if p and f and (s := walk(p, f))}


def test_codes(spark, rows):
    df = spark.createDataFrame([("heap-buffer-overflow",), (" Data Race",), ("alloc-dealloc-mismatch (x)",), ("a b--c!",)], "k string")
    rows(df.select(patches.sanitizer_code(F.col("k"))), ("SAN_HEAP_OVERFLOW",), ("SAN_DATA_RACE",), ("SAN_ALLOC_MISMATCH",), ("SAN_A_B_C",))
    df = spark.createDataFrame([("Cannot find implementation or library stub for module",), ("Untyped decorator makes function x",), ("other",), (None,)], "m string")
    rows(df.select(patches.message_code(F.col("m"))), ("import-untyped",), ("untyped-decorator",), ("",), ("",))


def test_figures_without_rows(spark, rows):
    runs = spark.createDataFrame([("a",), ("b",)], "run string")
    failures = spark.createDataFrame([("a", "net"), ("a", None), ("a", "net")], "run string, category string")
    rows(stats.infrastructure_failures(failures, runs, ["run"]), ("a", 3, "=1,net=2"), ("b", 0, ""))
    none = spark.createDataFrame([], "outcome string, findings long")
    rows(stats.series_summary(none), (0, 0, 0, 0, 0, None, 0))
    audits = spark.createDataFrame([("a", "f", True), ("a", "f", False), ("a", "g", True)], "run string, file string, passed boolean")
    rows(stats.audit_counts(audits, ["run"]), ("a", 1, 1))
