"""Queries of line diffs and renames."""

from pyspark.sql import functions as F

from tallyloom.operators import patience, renames
from tallyloom.plans.adapters import table
from tallyloom.plans.registry import query

#: Each document with one line replaced, one new line inserted, or one line deleted; every fourth stays as it is.
EDITED = """l AS (SELECT doc_id, text, string_split(replace(coalesce(text, ''), chr(10), chr(10)), chr(10)) AS ls FROM documents), e AS (SELECT doc_id, ls, len(ls) AS n, (doc_id * 7) % len(ls) AS k FROM l)"""


@query("x13_patience_hunks", f"""WITH {EDITED}, p AS (SELECT doc_id, k, n, unnest(ls) AS t, unnest(range(n)) AS i FROM e WHERE doc_id % 4 = 2), d AS (SELECT doc_id, n, min(i) AS i FROM (SELECT *, lead(t) OVER (PARTITION BY doc_id ORDER BY i) AS t2 FROM p) WHERE i >= k AND t IS DISTINCT FROM t2 GROUP BY doc_id, n)
SELECT doc_id, 'replace' AS tag, k AS i1, k + 1 AS i2, k AS j1, k + 1 AS j2 FROM e WHERE doc_id % 4 = 0 UNION ALL SELECT doc_id, 'insert', k, k, k, k + 1 FROM e WHERE doc_id % 4 = 1 UNION ALL SELECT doc_id, 'delete', i, i + 1, i, i FROM d""")
def x13_patience(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("ls")).withColumn("k", (F.col("doc_id") * 7 % F.size("ls")).cast("int"))
    part = lambda a, n: F.slice("ls", a, n)
    new = F.array(F.concat(F.lit("§ new line "), "doc_id"))
    rest = lambda skip: part(F.col("k") + 1 + skip, F.size("ls"))
    kind = F.col("doc_id") % 4
    after = F.when(kind == 0, F.concat(part(F.lit(1), F.col("k")), new, rest(1))).when(kind == 1, F.concat(part(F.lit(1), F.col("k")), new, rest(0))).when(kind == 2, F.concat(part(F.lit(1), F.col("k")), rest(1))).otherwise(F.col("ls"))
    whole = lambda c: F.concat(F.array_join(c, "\n"), F.lit("\n"))  # noqa: E731  so that an empty last line is a line
    pairs = docs.select(F.col("doc_id").alias("id"), whole(F.col("ls")).alias("before"), F.when(F.size(after) > 0, whole(after)).otherwise("").alias("after"))
    out = patience.hunks(pairs).withColumnRenamed("id", "doc_id")
    return out.select("doc_id", "tag", *[F.col(c).cast("long").alias(c) for c in ("i1", "i2", "j1", "j2")])


#: Names of all parts, in one change: those of even numbers go, those of odd ones come with an ending, a letter less, or in capitals.
CHANGED = {"old": "CASE WHEN p_partkey % 2 = 0 THEN concat(p_name, p_partkey % 100) END", "new": "CASE p_partkey % 8 WHEN 1 THEN concat(p_name, (p_partkey * 3) % 100) WHEN 3 THEN concat(substring(p_name, 2), p_partkey % 100) WHEN 5 THEN upper(concat(p_name, (p_partkey + 1) % 100)) WHEN 7 THEN concat(p_name, (p_partkey - 1) % 100) END"}


@query("j17_renames_joined", f"""WITH o AS (SELECT DISTINCT {CHANGED['old']} AS old FROM part), n AS (SELECT DISTINCT {CHANGED['new']} AS new FROM part), x AS (SELECT old FROM o WHERE old IS NOT NULL AND old NOT IN (SELECT new FROM n WHERE new IS NOT NULL)), y AS (SELECT new FROM n WHERE new IS NOT NULL AND new NOT IN (SELECT old FROM o WHERE old IS NOT NULL))
SELECT old, new, CASE WHEN lower(old) = lower(new) THEN 'case_rename' ELSE 'near_rename' END AS kind, CASE WHEN lower(old) <> lower(new) THEN levenshtein(lower(old), lower(new)) END AS distance FROM x, y
WHERE lower(old) = lower(new) OR (abs(length(old) - length(new)) <= 2 AND least(length(old), length(new)) >= 4 AND levenshtein(lower(old), lower(new)) <= 2)""")
def j17_joined(spark, d):
    names = table(spark, d, "part").selectExpr("1 AS change", *[f"{e} AS {n}" for n, e in CHANGED.items()])
    out = renames.renames(names.filter("old IS NOT NULL").select("change", "old"), names.filter("new IS NOT NULL").select("change", "new"), ["change"])
    return out.select("old", "new", "kind", F.col("distance").cast("long").alias("distance"))
