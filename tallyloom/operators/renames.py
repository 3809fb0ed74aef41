"""Names that stand for each other within two edits, found by a join of signatures instead of all pairs.

A name that is two edits away keeps at least one of three segments of the other, moved by two places at most.  So each removed name is
posted under its three segments, each added name under its pieces at the places where such a segment can lie; only pairs that
share a posting are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Edits that are allowed; the least length of a name that may differ by edits.
EDITS, LEAST = 2, 4


def _cut(length: Column, k: int) -> Column:
    """Place, from 0, where segment k of a name of a length begins."""
    return F.floor(length * k / (EDITS + 1)).cast("int")


def _segments(name: Column) -> Column:
    """Postings ``_length, _k, _piece`` of a removed name: its segments."""
    n = F.length(name)
    return F.array(*[F.struct(n.alias("_length"), F.lit(k).alias("_k"), F.substr(name, _cut(n, k) + 1, _cut(n, k + 1) - _cut(n, k)).alias("_piece")) for k in range(EDITS + 1)])


def _pieces(name: Column) -> Column:
    """Postings of an added name: for each length that the other can have, its pieces where that one's segments can lie."""
    found = []
    for d in range(-EDITS, EDITS + 1):
        n = F.length(name) + d
        for k in range(EDITS + 1):
            for shift in range(-EDITS, EDITS + 1):
                at, wide = _cut(n, k) + shift, _cut(n, k + 1) - _cut(n, k)
                piece = F.struct(n.alias("_length"), F.lit(k).alias("_k"), F.substr(name, at + 1, wide).alias("_piece"))
                found.append(F.when((at >= 0) & (at + wide <= F.length(name)) & (n >= LEAST), piece))
    return F.array_distinct(F.array_compact(F.array(*found)))


def candidates(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Distinct ``key, old, new`` that share a posting."""
    a = old.filter(F.length("old") >= LEAST).select(*key, "old", F.inline(_segments(F.lower("old"))))
    b = new.filter(F.length("new") >= LEAST).select(*key, "new", F.inline(_pieces(F.lower("new"))))
    return a.join(b, [*key, "_length", "_k", "_piece"]).select(*key, "old", "new").distinct()


def renames(removed: DataFrame, added: DataFrame, key: list[str], targets: DataFrame | None = None) -> DataFrame:
    """``key, old, new, kind, distance``: names of one change that went and came, equal but for case or within two edits of each other.

    removed: key and ``old``, added: key and ``new``, any number of rows a change.  Names that are in both go; so do, whatever their
    case, those of targets (key and ``name``), which the change was about.  Names of less than four letters pair by case alone.
    """
    old, new = removed.select(*key, "old").distinct(), added.select(*key, "new").distinct()
    both = old.join(new.withColumnRenamed("new", "old"), [*key, "old"], "left_semi")
    old, new = old.join(both, [*key, "old"], "left_anti"), new.join(both.withColumnRenamed("old", "new"), [*key, "new"], "left_anti")
    if targets is not None:
        named = targets.select(*key, F.lower("name").alias("_l")).distinct()
        old, new = (rows.withColumn("_l", F.lower(c)).join(named, [*key, "_l"], "left_anti").drop("_l") for rows, c in ((old, "old"), (new, "new")))
    low = lambda rows, c: rows.withColumn("_l", F.lower(c))
    same = low(old, "old").join(low(new, "new"), [*key, "_l"]).select(*key, "old", "new", F.lit("case_rename").alias("kind"), F.lit(None).cast("int").alias("distance"))
    far = F.levenshtein(F.lower("old"), F.lower("new"), EDITS)  # -1: more
    near = candidates(old, new, key).filter(F.lower("old") != F.lower("new")).withColumn("distance", far).filter("distance >= 0")
    return same.unionByName(near.select(*key, "old", "new", F.lit("near_rename").alias("kind"), "distance"))
