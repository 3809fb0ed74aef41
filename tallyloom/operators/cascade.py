"""Derived findings: what follows from a syntax error, from a missing dependency, or from one symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyloom.functions.rules import MISSING_DEPENDENCY
from tallyloom.functions.text import cascade_signature, symbols
from tallyloom.operators.graph import written
from tallyloom.plans.folders import shared_folder


def syntax_cascade(df: DataFrame) -> DataFrame:
    """Per file: the first CRITICAL_SYNTAX finding is a root; all others at its line or below derive from it."""
    df = df.withColumn("sig", cascade_signature(F.col("file"), F.col("line"), F.col("code"), F.col("message")))
    critical = (F.upper(F.coalesce("error_class", F.lit(""))) == "CRITICAL_SYNTAX") & (F.coalesce("file", F.lit("")) != "")
    roots = df.filter(critical).groupBy("file").agg(F.min(F.struct(F.coalesce("line", F.lit(0)).alias("line"), "seq", "sig")).alias("_root"))
    df = df.join(roots, "file", "left")
    is_root = F.coalesce(F.col("seq") == F.col("_root.seq"), F.lit(False))
    below = F.coalesce("line", F.lit(0)) >= F.col("_root.line")
    return df.withColumns({"is_root": is_root, "derived_from": F.when(~is_root & below, F.col("_root.sig"))}).drop("_root")


#: Letters of a name's begin under which messages are looked up, at most.
GRAM = 3


def mentions(texts: DataFrame, names: DataFrame) -> DataFrame:
    """Distinct ``file, message, name`` where a file's message has one of its names anywhere: a join on the name's first letters, then the whole name."""
    wide = F.least(F.length("name"), F.lit(GRAM))
    asked = names.select("file", "name", wide.alias("_w"), F.substr("name", F.lit(1), wide).alias("_g")).distinct()
    pieces = lambda w: F.transform(F.sequence(F.lit(1), F.length("message") - w + 1), lambda i: F.substr("message", i, F.lit(w)))
    posted = F.array_compact(F.array(*[F.when(F.length("message") >= w, F.struct(F.lit(w).alias("w"), F.array_distinct(pieces(w)).alias("g"))) for w in range(1, GRAM + 1)]))
    held = texts.select("file", "message").distinct().select("file", "message", F.explode(posted).alias("p")).select("file", "message", F.col("p.w").alias("_w"), F.explode("p.g").alias("_g"))
    return held.join(asked, ["file", "_w", "_g"]).filter(F.contains("message", F.col("name"))).select("file", "message", "name").distinct()


def dependency_cascade(df: DataFrame) -> DataFrame:
    """Per file, in line order: a finding with a missing-dependency code that is not derived yet roots all later findings that mention one of its symbols.

    Which candidates are roots depends on those before them, so they are settled in rounds: a candidate is a root once no candidate
    before it that may still be one has a symbol that it mentions, and derived once a root before it has.  Each round settles the
    first open one of every file at least, in practice nearly all.  All steps are joins by file and symbol or message, so a file is no group
    of its own; findings without a file are left out.  Ties in line and seq are told apart by code and message.  df: the result of syntax_cascade.
    """
    folder, key, names = shared_folder(df.sparkSession, "cascade"), ["file", "_l", "seq", "code", "message", "_id"], df.columns
    df = written(df.withColumn("_id", F.monotonically_increasing_id()), f"{folder}/rows")  # ids as written
    free = df.filter((F.coalesce("file", F.lit("")) != "") & F.col("derived_from").isNull()).select("file", F.coalesce("line", F.lit(0)).alias("_l"), "seq", "code", F.coalesce("message", F.lit("")).alias("message"), "_id", "sig")
    holds = written(free.filter(F.col("code").isin(*MISSING_DEPENDENCY)).select(*key, "sig", F.explode(symbols(F.col("message"))).alias("name")), f"{folder}/holds")
    said = written(mentions(free, holds), f"{folder}/said")
    hears = written(holds.select(*key).distinct().join(said, ["file", "message"]).select(*key, "name"), f"{folder}/hears")
    status = written(holds.select(*key).distinct().withColumn("root", F.lit(None).cast("boolean")), f"{folder}/round=0")
    place, number = F.struct("_l", "seq", "code", "message", "_id"), 0
    while not status.filter("root IS NULL").isEmpty():
        able = holds.join(status.filter("root IS NULL OR root"), key)
        first = able.groupBy("file", "name").agg(F.min(place).alias("any"), F.min(F.when(F.col("root"), place)).alias("sure"))
        judged = hears.join(status.filter("root IS NULL").select(*key), key).join(first, ["file", "name"], "left")
        judged = judged.groupBy(*key).agg(F.bool_or(F.coalesce(F.col("any") < place, F.lit(False))).alias("waits"), F.bool_or(F.coalesce(F.col("sure") < place, F.lit(False))).alias("derived"))
        new = judged.select(*key, F.when(F.col("derived"), False).when(~F.col("waits"), True).alias("root"))
        number += 1
        status = written(status.filter("root IS NOT NULL").unionByName(new), f"{folder}/round={number}")
    roots = status.filter("root")
    source = holds.join(roots.select(*key), key).groupBy("file", "name").agg(F.min(F.struct("_l", "seq", "code", "message", "_id", "sig")).alias("r"))
    marks = free.join(said.join(source, ["file", "name"]), ["file", "message"]).filter((F.col("_l") >= F.col("r._l")) & (F.col("_id") != F.col("r._id")))
    marks = marks.groupBy("_id").agg(F.min("r").alias("_r"))
    out = df.join(marks, "_id", "left").join(roots.select("_id", F.lit(True).alias("_root")), "_id", "left")
    return out.withColumns({"is_root": F.col("is_root") | F.coalesce("_root", F.lit(False)), "derived_from": F.coalesce("derived_from", "_r.sig")}).select(*names)


#: Findings that share a first symbol from which on its root is told to all tasks; there is one such symbol for as many findings at most.
HOT = 1 << 16


def symbol_cascade(df: DataFrame, least: int = 3, row: str = "seq") -> DataFrame:
    """Of the findings left, those that share their first symbol with two more: the earliest by file and line is the root of the others.

    row: the column that tells findings apart; findings with the root's value are roots as well.  Frequent symbols are told to all tasks, the
    other findings are spread over them, with or without a symbol, so no task gets all findings of one symbol, or all without.
    """
    free = F.col("derived_from").isNull() & ~F.col("is_root")
    df = df.withColumn("_s", F.when(free, F.get(symbols(F.col("message")), F.lit(0))))
    place = F.struct(F.coalesce("file", F.lit("")).alias("f"), F.coalesce("line", F.lit(0)).alias("l"), "seq", "sig", F.col(row).alias("row"))
    if row != "seq":
        place = F.struct(F.coalesce("file", F.lit("")).alias("f"), F.coalesce("line", F.lit(0)).alias("l"), "seq", F.col(row).alias("row"), "sig")
    first = df.filter("_s IS NOT NULL").groupBy("_s").agg(F.count("*").alias("_k"), F.min(place).alias("_first")).filter(F.col("_k") >= least)
    first = written(first, shared_folder(df.sparkSession, "first"))
    hot = first.filter(F.col("_k") >= HOT).select("_s", F.col("_first").alias("_hot"))
    cold = first.filter(F.col("_k") < HOT).select(F.col("_s").alias("_c"), F.col("_first").alias("_cold"))
    df = df.join(F.broadcast(hot), "_s", "left")
    spread = F.concat(F.lit("\0"), F.pmod(F.xxhash64("seq", "line", "code"), F.lit(4096)).cast("string"))  # no symbol
    df = df.withColumn("_c", F.when(F.col("_hot").isNull(), F.col("_s"))).withColumn("_c", F.coalesce("_c", spread)).join(cold, "_c", "left")
    df = df.withColumn("_first", F.coalesce("_hot", "_cold"))
    mine = F.col("_first").isNotNull()
    at = F.col(row) == F.col("_first.row")
    return df.withColumns({"is_root": F.col("is_root") | F.coalesce(mine & at, F.lit(False)), "derived_from": F.when(mine & ~at, F.col("_first.sig")).otherwise(F.col("derived_from"))}).drop("_s", "_c", "_hot", "_cold", "_first")


def collapse(df: DataFrame) -> DataFrame:
    """All three rules; ``rank`` is the place in the final order: roots and single findings first, each part in its old order."""
    out = symbol_cascade(dependency_cascade(syntax_cascade(df)))
    return out.withColumn("derived", F.col("derived_from").isNotNull())


def groups(collapsed: DataFrame) -> DataFrame:
    """Per root signature: how many findings derive from it, and the first of them."""
    own = F.col("derived_from").isNull()
    out = collapsed.groupBy(F.coalesce("derived_from", "sig").alias("sig")).agg(F.count_if(own).alias("_own"), F.min(F.when(own, F.col("seq"))).alias("root"), F.count("derived_from").alias("derived"), F.min(F.when(~own, F.col("seq"))).alias("first"))
    return out.filter("_own > 0").drop("_own")
