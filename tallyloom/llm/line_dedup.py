"""Line dedup over the whole corpus, with DataFrame operations only.

Lines are exploded, normalised and hashed (128 bits); documents are counted per hash; the lines of
frequent hashes go, except in the largest document id that holds them; texts are put together again
by line position.  Only hashes and positions are shuffled for the counting; texts move once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyloom.llm.scratch import stash

SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def dedup_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """docs with columns ``n_lines, n_dropped, kept_text`` added.

    A null or empty text is one empty line; a null doc_id is one document, smaller than all others; rows
    that repeat a doc_id count as one document, and each keeps or loses lines like it; keys shorter than
    min_chars code points always stay; texts and lines of any length are read whole; doc_ids must be numbers (a string that is none
    fails the cast); an empty table gives an empty result.  docs may have any other
    columns; of those named like an added one, the added one stays.
    """
    added = ("n_lines", "n_dropped", "kept_text")
    own = [c for c in docs.columns if c not in added]
    body = F.coalesce(F.col(text), F.lit(""))
    # the document's own columns travel as one, so that no name can clash
    known = docs.select(F.struct(*own).alias("_ld_doc"), F.col(doc_id).isNull().alias("_ld_null"), F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63))).alias("_ld_id"), F.xxhash64(body).alias("_ld_text"), body.alias("_ld_body"))
    body = F.col("_ld_body")
    lines = F.split(body, "\n", -1)
    row = ["_ld_null", "_ld_id", "_ld_text"]
    exploded = known.select(*row, F.posexplode(lines).alias("_ld_pos", "_ld_line")).withColumn("_ld_key", line_key(F.col("_ld_line"))).filter(F.char_length("_ld_key") >= min_chars)
    hashed = stash(exploded.select(*row, "_ld_pos", F.xxhash64("_ld_key").alias("_ld_h1"), F.xxhash64(F.lit(7), F.col("_ld_key")).alias("_ld_h2")), "line-hashes")
    key = ["_ld_h1", "_ld_h2"]
    holder = F.struct(~F.col("_ld_null"), F.col("_ld_id"))
    frequent = hashed.select(*key, "_ld_null", "_ld_id").distinct().groupBy(*key).agg(F.count("*").alias("_ld_n"), F.max(holder).alias("_ld_keeper")).filter(F.col("_ld_n") >= min_docs).drop("_ld_n")
    frequent = stash(frequent, "line-frequent")  # as a table, so that both sides of the join are plain exchanges, whose hot keys Spark splits
    dropped = hashed.join(frequent, key).filter(holder != F.col("_ld_keeper")).groupBy(*row).agg(F.array_distinct(F.collect_list("_ld_pos")).alias("_ld_drop"))
    dropped = stash(dropped, "line-drops")
    # the same plan at every size: texts move once, however few lines go
    joined = known.join(dropped.hint("merge"), row, "left")
    kept = F.transform(F.array(lines), lambda a: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(a) - 1), F.col("_ld_drop")), lambda p: F.get(a, p)), "\n"))
    out = joined.withColumns({"n_lines": F.size(lines).cast("long"), "n_dropped": F.coalesce(F.size("_ld_drop"), F.lit(0)).cast("long"), "kept_text": F.when(F.col("_ld_drop").isNull(), body).otherwise(F.get(kept, F.lit(0)))})
    return out.select("_ld_doc.*", *added)


def drop_frequent_lines(docs: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """docs with the frequent lines gone from their texts; n_chars, if there, is that of the new text.

    Rows, columns and odd values are as in dedup_lines: every row stays, a null text becomes empty, repeated rows lose the same lines.
    """
    out = dedup_lines(docs, text=text, **options).withColumn(text, F.col("kept_text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length(text).cast("long"))
    return out.select(*docs.columns)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of at least 40 code points that at least five documents hold stay only in the largest doc_id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, u.pos, u.line, translate(trim(u.line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
      FROM d, LATERAL (SELECT unnest(ls) AS line, generate_subscripts(ls, 1) AS pos) AS u),
f AS (SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT l.doc_id, l.pos, l.line, f.k IS NOT NULL AND l.doc_id <> f.keeper AS gone FROM l LEFT JOIN f ON l.k = f.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
