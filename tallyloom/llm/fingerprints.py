"""Document fingerprints: bottom-k sketches of word-shingle hashes, with DataFrame operations only.

A sketch is the sorted array of the k smallest distinct hashes of a document's shingles.  Sketches of
parts merge by taking the k smallest of their union; two sketches estimate resemblance, containment
and the number of distinct shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tallyloom.llm.line_dedup import LOWER, UPPER

SPACES = r"[\x20\x09-\x0D]+"
K, SHINGLE = 128, 5
#: Bounds on the key ranges that documents are dealt to for finding each one's successor.
MAX_RANGES, RANGE_BYTES, QUANTILES = 65536, 16 << 20, 64


def sketch(text: Column, k: int = K, words: int = SHINGLE) -> Column:
    """Sorted k smallest distinct 64-bit hashes of the text's shingles; fewer words make one shingle, no word gives an empty sketch."""
    split = F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SPACES), "")
    shingles = F.transform(F.array(split), lambda ws: F.when(F.size(ws) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(F.size(ws) - words, F.lit(0))), lambda i: F.xxhash64(*[F.get(ws, i + j) for j in range(words)]))))
    return bottom(F.get(shingles, F.lit(0)), k)


def bottom(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of what a and b were made of."""
    return bottom(F.concat(a, b), k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity, 0 to 1; two empty sketches are alike (1)."""
    both = F.array_intersect(a, b)
    union = merge(a, b, k)
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(union, both)) / F.size(union))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k, else (k - 1) over the share of the hash range that the sketch covers."""
    covered = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(k - 1.0) / covered)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has."""
    r = resemblance(a, b, k)
    n = distinct_count(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), r * n / distinct_count(a, k)))


def to_text(a: Column) -> Column:
    """16 hexadecimal digits per hash."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def _ranges(docs: DataFrame) -> Column:
    """A range number that rises with _id and gives ranges of about RANGE_BYTES of text, MAX_RANGES at most; null ids come first.

    Quantiles of all ids give 64 ranges; each is divided into equal widths.
    """
    at = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length("_text")).alias("bytes"), F.min("_id").alias("lo"), F.max("_id").alias("hi"), F.percentile_approx("_id", F.array(*[F.lit(i / QUANTILES) for i in range(1, QUANTILES)]), F.lit(10000)).alias("cuts")).first()
    if at.lo is None:
        return F.lit(-1).cast("long")
    edges = [at.lo, *sorted({c for c in at.cuts if at.lo < c <= at.hi}), at.hi + 1]
    parts = max(1, min(MAX_RANGES, -(-(at.bytes or 0) // RANGE_BYTES)) // (len(edges) - 1))
    edge = F.array(*[F.lit(e) for e in edges])
    part = F.size(F.filter(F.array(*[F.lit(e) for e in edges[1:-1]]).cast("array<bigint>"), lambda e: e <= F.col("_id")))
    lo, hi = F.get(edge, part), F.get(edge, part + 1)
    inner = F.least(F.floor((F.col("_id") - lo).cast("double") / (hi - lo) * parts), F.lit(parts - 1))
    return F.coalesce(part * parts + inner, F.lit(-1)).cast("long")


def fingerprint_with_next(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", k: int = K, words: int = SHINGLE) -> DataFrame:
    """``doc_id, text, sketch, next_text, next_sketch``: each document with the next one in descending doc_id (after the last, the first).

    Documents are dealt to ranges of doc_id and sorted there; the last of a range gets the first of the
    next range.  Texts are shuffled once.  Null text: empty.  Null ids come last, equal ids in
    order of their texts, so repeated rows follow each other; a table of one row is its own successor; an empty table gives an
    empty result; doc_ids must be numbers.  Texts of any length are read whole.  Other columns of docs are not read.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    docs = docs.withColumn("_range", _ranges(docs))
    order = [F.col("_id").desc_nulls_last(), F.col("_text")]
    # at most MAX_RANGES rows: the first document of each range, and the range after it
    heads = docs.groupBy("_range").agg(F.max("_id").alias("_head"))
    heads = heads.withColumn("_of", F.coalesce(F.lag("_range").over(W.orderBy(F.col("_range").desc())), F.min("_range").over(W.partitionBy())))
    first = docs.join(F.broadcast(heads.withColumnRenamed("_range", "_r")), (F.col("_range") == F.col("_r")) & F.col("_id").eqNullSafe(F.col("_head")))
    first = first.groupBy("_of").agg(F.min("_text").alias("_first")).withColumn("_first_sketch", sketch(F.col("_first"), k, words))
    dealt = docs.repartition("_range").withColumn("_sketch", sketch(F.col("_text"), k, words))
    here = W.partitionBy("_range").orderBy(*order)
    led = dealt.withColumns({"_next": F.lead("_text").over(here), "_next_sketch": F.lead("_sketch").over(here)})
    led = led.join(first, (F.col("_range") == F.col("_of")) & F.col("_next").isNull(), "left")
    return led.select(F.col("_id").alias("doc_id"), F.col("_text").alias("text"), F.col("_sketch").alias("sketch"), F.coalesce("_next", "_first").alias("next_text"), F.coalesce("_next_sketch", "_first_sketch").alias("next_sketch"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its text with the second half taken from the next document."""
    rows = fingerprint_with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumns({"n_chars": n.cast("long"), "_edited": F.concat(F.substr("text", F.lit(1), n - half), F.substr("next_text", F.lit(1), half))})
    rows = rows.select("doc_id", "n_chars", F.sha2("_edited", 256).alias("edited_sha256"), "sketch", "next_sketch", sketch(F.col("_edited")).alias("_edited_sketch"))
    return rows.select("doc_id", "n_chars", "edited_sha256", to_text(F.col("sketch")).alias("fingerprint"), to_text(F.col("_edited_sketch")).alias("edited_fingerprint"), resemblance(F.col("sketch"), F.col("_edited_sketch")).alias("near_edited"), resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"))
