"""Mixing sources to target weights, with DataFrame operations only.

Every document gets a hash-random key.  Rows are dealt to key ranges of their source (4096 equal
ranges, which hold equal shares because the keys are hashes), sorted by key in each range, and
summed up: a running sum in the range, on top of the sums of all ranges before it.  The running sum
over the whole source then says which documents lie before the source's budget, and where the
budget cuts the last of them.  Budgets over the source's size repeat whole epochs first.

Nothing is collected: per-range sums are at most 4096 rows a source, and the only unpartitioned
window runs over one row per source, so sources should be few beside documents (names, not URLs).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tallyloom.llm.scratch import stash

WORD = r"[^\x20\x09-\x0D]+"
SEED = 17
SOURCE = ("_snull", "_sval")


def _source_keys(source: str) -> list[Column]:
    """A null source as a value of its own that sorts last."""
    return [F.col(source).isNull().alias(SOURCE[0]), F.coalesce(F.col(source).cast("string"), F.lit("")).alias(SOURCE[1])]


def _place(doc_id: str, text: str, seed: int) -> list[Column]:
    """What documents of a source are sorted by; rows that agree in all of it have the same id and text."""
    return [_key(doc_id, seed).alias("_key"), F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("_text")]


def _key(doc_id: str, seed: int) -> Column:
    """32 hexadecimal digits; SQL engines agree on them."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(doc_id).cast("string")))


def source_targets(sizes: DataFrame, weights=(5, 2, 1), max_epochs: int = 3, share: float = 1.0) -> DataFrame:
    """One row per source: words to take, by weight, at most max_epochs times what the source has.

    sizes: ``_snull, _sval, source_size``.  Sources stand in code-point order (null last) and take the
    weights in turn.  The excess of sources that reach their limit goes to the others by weight.  With
    the sources sorted by limit / weight, those that reach it come first, so one pass of running sums
    finds the level at which the rest shares what is left.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(W.orderBy(*SOURCE)) - 1) % len(weights) + 1)
    ranked = sizes.withColumn("_w", w).withColumn("_limit", F.col("source_size") * float(max_epochs)).withColumn("_ratio", F.col("_limit") / F.col("_w"))
    order = W.orderBy("_ratio", *SOURCE)
    before = F.coalesce(F.sum("_limit").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("_w").over(order.rowsBetween(0, W.unboundedFollowing))
    total = F.sum("source_size").over(W.partitionBy()) * F.lit(float(share))
    ranked = ranked.withColumn("_rank", F.row_number().over(order)).withColumn("_level", (total - before) / rest)
    level = F.coalesce(F.min_by(F.when(F.col("_ratio") > F.col("_level"), F.col("_level")), F.when(F.col("_ratio") > F.col("_level"), F.col("_rank"))).over(W.partitionBy()), F.lit(float("inf")))
    return ranked.withColumn("target", F.least(F.col("_limit"), F.col("_w") * level)).select(*SOURCE, "source_size", "target")


def mix_plan(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights=(5, 2, 1), max_epochs: int = 3, share: float = 1.0, seed: int = SEED) -> DataFrame:
    """One row per row of docs: ``doc_id, source, _snull, _sval, _key, _text, size, source_size, target, budget, taken``.

    A null text has no words; a null source is a source of its own; a null doc_id is an id like others; repeated rows count each for
    themselves: those of one doc_id stand in the order of their texts' hashes, and equal ones are
    interchangeable; an empty table gives an empty plan.  ``taken`` are the words that the mix takes of the
    document: whole epochs, then the document as far as the source's budget (the target without
    its fraction) reaches.  Other columns of docs are not read.
    """
    sized = stash(docs.select(*_place(doc_id, text, seed), F.col(source).alias("source"), *_source_keys(source), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size")), "mix-sizes")
    sized = sized.withColumn("_range", F.conv(F.substring("_key", 1, 3), 16, 10).cast("int"))
    ranges = sized.groupBy(*SOURCE, "_range").agg(F.sum("size").alias("_sum")).withColumn("_top", F.shiftright("_range", 6))
    tops = ranges.groupBy(*SOURCE, "_top").agg(F.sum("_sum").alias("_top_sum"))
    targets = source_targets(sized.groupBy(*SOURCE).agg(F.sum("size").alias("source_size")), weights, max_epochs, share)
    earlier = lambda col, part, order: F.coalesce(F.sum(col).over(W.partitionBy(*part).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    tops = tops.withColumn("_before_top", earlier("_top_sum", SOURCE, "_top")).drop("_top_sum").join(targets, [*SOURCE])
    ranges = ranges.withColumn("_before", earlier("_sum", (*SOURCE, "_top"), "_range")).join(tops, [*SOURCE, "_top"]).drop("_sum", "_top")
    running = F.sum("size").over(W.partitionBy(*SOURCE, "_range").orderBy("_key", "doc_id", "_text").rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    rows = sized.withColumn("_inside", running).join(ranges, [*SOURCE, "_range"])
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0))
    rows = rows.withColumn("budget", budget).withColumn("_epochs", epochs)
    left = F.col("budget") - F.col("_epochs") * F.col("source_size") - F.col("_before_top") - F.col("_before") - F.col("_inside")
    rows = rows.withColumn("_left", left.cast("long"))
    return rows.withColumn("taken", F.col("_epochs") * F.col("size") + F.greatest(F.lit(0), F.least("size", "_left")).cast("long"))


def mix(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mixed documents: each as often as the mix takes it, the last of a source cut at the budget; columns as before, and n_chars, if there, of the new text.

    Only each source's place of the cut (one row per source) is joined back, so texts are not shuffled:
    documents before it are taken once more than the whole epochs.  A document cut by the budget keeps
    its first words with the white space before them.  Rows that stand at the cut together (repeated rows, whose ids and
    texts are equal) are numbered, and take the budget that is left one after the other; only these are shuffled.
    Null and empty texts have no words and go with whole epochs or with a place before the cut; a null source
    or doc_id is one like others; an empty table gives an empty result; columns of any name stay as they are.
    """
    plan = mix_plan(docs, doc_id=doc_id, text=text, source=source, **options)
    place = ["_key", "doc_id", "_text"]
    # the first of the rows at the cut has most of the budget left
    cut = F.max(F.when((F.col("_left") > 0) & (F.col("size") > 0), F.struct(*place, "_left"))).alias("_cut")
    cuts = plan.groupBy(*SOURCE).agg(F.max("_epochs").alias("_epochs"), cut)
    cuts = stash(cuts.select(*SOURCE, "_epochs", F.struct(*[F.col("_cut").getField(c).alias(c) for c in place]).alias("_cut"), F.col("_cut._left").alias("_left")), "mix-cuts")
    body = F.col("doc").getField(text)
    # the document's own columns travel as one, so that no name can clash
    at = docs.select(F.struct(*docs.columns).alias("doc"), *_source_keys(source), F.struct(*_place(doc_id, text, options.get("seed", SEED))).alias("_at")).join(cuts, [*SOURCE])
    here = F.col("_left").isNotNull() & F.col("_at").eqNullSafe(F.col("_cut"))
    n_words = F.coalesce(F.regexp_count(body, F.lit(WORD)), F.lit(0)).cast("long")
    before = at.filter(~here).withColumn("_times", F.col("_epochs").cast("long") + F.when(F.col("_left").isNotNull() & (F.col("_at") < F.col("_cut")), 1).otherwise(0)).withColumn("_part", F.lit(None).cast("long"))
    turn = F.row_number().over(W.partitionBy(*SOURCE).orderBy(F.to_json("doc"))) - 1
    tied = at.filter(here).withColumn("_part", F.greatest(F.lit(0), F.least(n_words, F.col("_left") - turn * n_words)))
    tied = tied.withColumn("_times", F.col("_epochs").cast("long") + F.when(F.col("_part") > 0, 1).otherwise(0)).withColumn("_part", F.when(F.col("_part") > 0, F.col("_part")))
    own = ["doc", "_times", "_part"]
    at = before.select(*own).unionByName(tied.select(*own)).filter("_times > 0").withColumn("_turn", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int"))))
    partly = F.coalesce((F.col("_turn") == F.col("_times")) & (F.col("_part") < n_words), F.lit(False))
    head = F.array_join(F.slice(F.split(body, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"), F.lit(1), F.col("_part").cast("int")), "")
    at = at.withColumn("doc", F.col("doc").withField(text, F.when(partly, head).otherwise(body)))
    if "n_chars" in docs.columns:
        at = at.withColumn("doc", F.col("doc").withField("n_chars", F.coalesce(F.char_length(body), F.lit(0)).cast("long")))
    return at.select("doc.*")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix all documents by source, weights 5, 2, 1 in turn, at most three epochs."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_plan(docs).select("doc_id", "size", "source_size", "target", "taken")


OP2_SQL = r"""
WITH d AS (SELECT doc_id, source, md5('17:' || doc_id) AS k, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk FROM d GROUP BY source),
w AS (SELECT *, CASE rk % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, 3.0::DOUBLE * source_size AS cap FROM s),
o AS (SELECT *, cap / w AS ratio, row_number() OVER q AS n,
        (sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(w) OVER (ORDER BY cap / w, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
      FROM w WINDOW q AS (ORDER BY cap / w, rk)),
v AS (SELECT coalesce(arg_min(level, n) FILTER (WHERE ratio > level), 'inf'::DOUBLE) AS level FROM o),
t AS (SELECT source, source_size, least(cap, w * v.level) AS target FROM o, v),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
        (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id ROWS UNBOUNDED PRECEDING) - d.size)::BIGINT AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CASE WHEN source_size = 0 THEN 0 ELSE
  (budget // source_size) * size + greatest(0, least(size, budget - (budget // source_size) * source_size - before)) END::BIGINT AS taken
FROM p
"""
