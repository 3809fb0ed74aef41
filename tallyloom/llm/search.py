"""Ranked lexical search as a product of sparse matrices: items by terms, times terms by documents.

Documents are tokenised once per block of items, into written blocks of some thousand documents: for the terms that any item of
the block holds, which documents hold them and how often, ordered by term (compressed rows of the term-document matrix).  Document
frequencies and lengths are summed from these blocks.  Then each row of the item-term matrix is multiplied with a block as
Gustavson does it: the block's rows of the item's terms are merged into one accumulator over its documents, in 64-bit integers.
A block leaves an item's best documents only where they beat those of the blocks before, a task its best
``most`` of each item, and two windows reduce the tasks' lists.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tallyloom.llm.scratch import stash
from tallyloom.llm.textscan import NO_TERM, batches

#: Documents of an item; length normalisation in percent; distinct terms of a block of items (about).
MOST, LENGTH, ITEM_TERMS = 50, 50, 1 << 18
#: Documents and matrix entries of a block of documents, at most, but for one with a long text; lists of tasks that one window reduces first.
DOCS, ENTRIES, SALTS = 4096, 1 << 20, 256
FIRST = -(2**63)
BLOCK = "docs long, words long, ids binary, sizes binary, terms binary, places binary, times binary"


def item_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``item, term, times``: hash and multiplicity of each term of each item; rows that repeat an item_id are one item with the terms of all."""
    kind = items.schema[item_id].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for lo, _, t in batches(part.column("text")):
                t.words(NO_TERM)
                yield pa.RecordBatch.from_arrays([part.column("item").take(pa.array(t.of + lo)), pa.array(t.hashes(t.start, t.end, lower=True).view(np.int64))], names=["item", "term"])

    found = items.select(F.col(item_id).alias("item"), F.col(text).alias("text")).mapInArrow(run, f"item {kind}, term long")
    return found.groupBy("item", "term").agg(F.count("*").alias("times"))


class Items:
    """A block of items as compressed rows: the terms of item i and their multiplicity are those at edge[i]:edge[i + 1]."""

    def __init__(self, table: pa.Table, once: bool):
        table = table.sort_by([("item", "ascending"), ("term", "ascending")])
        self.vocabulary = np.unique(table.column("term").to_numpy().view(np.uint64))
        self.term = np.searchsorted(self.vocabulary, table.column("term").to_numpy().view(np.uint64))
        self.times = np.ones(len(self.term), np.int64) if once else table.column("times").to_numpy().astype(np.int64)
        item = table.column("item").combine_chunks()
        number = item.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)  # in order of appearance: ascending
        first = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1]))) if len(number) else np.zeros(0, np.int64)
        self.edge = np.append(first, len(number))
        self.ids = item.take(pa.array(first))


def _matrix(shared):
    """Blocks of the term-document matrix over the vocabulary of shared."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        held: list[tuple] = []
        docs = words = rows = entries = 0

        def flush() -> pa.RecordBatch:
            ids, sizes, place, term, times = (np.concatenate(c) for c in zip(*held, strict=True)) if held else (np.zeros(0, np.int64),) * 5
            order = np.lexsort((place, term))
            packed = [ids.astype("<i8"), sizes.astype("<i8"), term[order].astype("<i4"), place[order].astype("<i4"), times[order].astype("<i8" if times.size and times.max() >> 31 else "<i4")]
            return pa.RecordBatch.from_arrays([pa.array([docs], pa.int64()), pa.array([words], pa.int64()), *[pa.array([x.tobytes()], pa.binary()) for x in packed]], names=["docs", "words", "ids", "sizes", "terms", "places", "times"])

        for part in parts:
            names = part.column("id").to_numpy(zero_copy_only=False)
            for lo, hi, t in batches(part.column("text")):
                t.words(NO_TERM)
                size = np.diff(t.first)
                docs, words = docs + int(np.count_nonzero(size)), words + int(size.sum())
                h = t.hashes(t.start, t.end, lower=True)
                at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
                known = np.flatnonzero(vocabulary[at] == h)
                key, times = np.unique(t.of[known] * len(vocabulary) + at[known], return_counts=True)
                place, term = np.divmod(key, len(vocabulary))
                met, place = np.unique(place, return_inverse=True)
                held.append((names[lo:hi][met], size[met], place + rows, term, times))
                rows, entries = rows + len(met), entries + len(key)
                if rows >= DOCS or entries >= ENTRIES:
                    yield flush()
                    held, docs, words, rows, entries = [], 0, 0, 0, 0
        if docs:
            yield flush()

    return run


class Block:
    """A row of the written matrix."""

    def __init__(self, row: dict):
        self.ids, self.sizes = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["sizes"], "<i8")
        self.term, self.place = np.frombuffer(row["terms"], "<i4"), np.frombuffer(row["places"], "<i4")
        self.times = np.frombuffer(row["times"], "<i8" if len(row["times"]) == 8 * len(self.term) else "<i4").astype(np.int64)


def _blocks(parts: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for part in parts:
        for i in range(part.num_rows):
            yield Block({c: part.column(c)[i].as_py() for c in ("ids", "sizes", "terms", "places", "times")})


def _frequencies(terms: int):
    """Documents that hold each term, of a task's blocks."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(terms, np.int64)
        for part in parts:
            for row in part.column("terms"):
                total += np.bincount(np.frombuffer(row.as_py(), "<i4"), minlength=terms)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(total[met])], names=["term", "df"])

    return run


def impacts(block: Block, weight: np.ndarray, docs: int, words: int, length: int) -> np.ndarray:
    """What each entry of the block adds to a score; lengths beyond 64 bits are divided by Python's integers."""
    if int(block.sizes.max(initial=0)) * docs * length < 2**63:
        norm = 100 - length + length * block.sizes * docs // words
    else:
        norm = np.array([100 - length + length * int(n) * docs // words for n in block.sizes], np.int64)
    return weight[block.term] * (1_000_000_000 * block.times // (1000 * block.times + 20 * norm[block.place]))


def _best(shared, most: int):
    """``item, doc_id, score`` of the task's best documents of each item."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weight, docs, words, length = shared.value
        none = np.zeros(0, np.int64)
        ids, scores = [none] * len(items.ids), [none] * len(items.ids)
        for block in _blocks(parts):
            value = impacts(block, weight, docs, words, length)
            row = np.searchsorted(block.term, np.arange(len(weight) + 1))
            total = np.zeros(len(block.ids), np.int64)
            for i in range(len(items.ids)):
                total[:] = 0
                for k in range(items.edge[i], items.edge[i + 1]):
                    lo, hi = row[items.term[k]], row[items.term[k] + 1]
                    if hi > lo:  # a document is in a term's row once
                        total[block.place[lo:hi]] += value[lo:hi] * items.times[k]
                least = scores[i][-1] if len(scores[i]) == most else 1  # equal scores are told apart by doc_id
                over = np.flatnonzero(total >= least)
                if len(over) > 4 * most:
                    over = over[total[over] >= np.partition(total[over], len(over) - most)[len(over) - most]]
                if len(over):
                    name, score = np.concatenate((ids[i], block.ids[over])), np.concatenate((scores[i], total[over]))
                    order = np.lexsort((name, -score))[:most]
                    ids[i], scores[i] = name[order], score[order]
        count = [len(x) for x in ids]
        yield pa.RecordBatch.from_arrays([items.ids.take(pa.array(np.repeat(np.arange(len(count)), count))), *[pa.array(np.concatenate([none, *x])) for x in (ids, scores)]], names=["item", "doc_id", "score"])

    return run


def search(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", most: int = MOST, once: bool = True, length: int = LENGTH) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``most`` best documents of each item with a score above 0, from rank 1, ties by ascending doc_id.

    All documents are ranked for all items; once: an item's repeated terms count once, else as often as they stand
    there.  doc_ids are numbers; a null doc_id is smaller than all others.  Each row of docs is a document, so repeated rows are ranked each;
    rows that repeat an item_id (null too) are one item with the terms of all.  Null or empty texts have no terms: such a document
    counts nowhere, such an item has no rows.  Empty tables give an empty result; other columns are not read.

    Items are taken in blocks of about ITEM_TERMS distinct terms, each with a pass over docs; a block is all that goes to every task.
    """
    spark = docs.sparkSession
    queries = stash(item_terms(items, item_id, item_text), "items")
    blocks = -(-queries.count() // ITEM_TERMS)
    plain = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(FIRST)).alias("id"), F.col(text).alias("text"))
    lists = [_lists(spark, plain, Items(queries.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).toArrow(), once), most, length, queries) for b in range(blocks)]
    every = reduce(DataFrame.unionByName, lists) if lists else queries.selectExpr("item", "0L AS task", "0L AS doc_id", "0L AS score").filter("false")
    order = [F.desc("score"), F.asc("doc_id")]
    for key in (["item", "salt"], ["item"]):
        place = F.row_number().over(W.partitionBy(*key).orderBy(*order))
        every = every.withColumn("salt", F.pmod("task", F.lit(SALTS))).withColumn("rank", place).filter(F.col("rank") <= most)
    return every.select(F.col("item").alias("item_id"), "rank", F.when(F.col("doc_id") != FIRST, F.col("doc_id")).alias("doc_id"), "score")


def _lists(spark: SparkSession, docs: DataFrame, items: Items, most: int, length: int, queries: DataFrame) -> DataFrame:
    """The tasks' lists for a block of items."""
    kind = queries.schema["item"].dataType.simpleString()
    empty = queries.selectExpr("item", "0L AS task", "0L AS doc_id", "0L AS score").filter("false")
    if not len(items.ids):
        return empty
    matrix = stash(docs.mapInArrow(_matrix(spark.sparkContext.broadcast(items.vocabulary)), BLOCK), "matrix")
    total = matrix.agg(F.sum("docs").alias("docs"), F.sum("words").alias("words")).first()
    if not total.docs:
        return empty
    weight = np.full(len(items.vocabulary), 0, np.int64)
    for r in matrix.select("terms").mapInArrow(_frequencies(len(weight)), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # the block's terms
        weight[r.term] = math.floor(1000 * math.log((2 * total.docs + 2) / (2 * r.df + 1)))
    shared = spark.sparkContext.broadcast((items, weight, total.docs, total.words, length))
    found = matrix.select("ids", "sizes", "terms", "places", "times").mapInArrow(_best(shared, most), f"item {kind}, doc_id long, score long")
    return found.withColumn("task", F.spark_partition_id().cast("long"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best of all documents for each benchmark item."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return search(read("documents"), read("benchmark"))


OP11_SQL = r"""
WITH words AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM documents),
aims AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM benchmark),
sizes AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
whole AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS all_words FROM sizes),
times AS (SELECT doc_id, w, count(*) AS tf FROM words WHERE w IN (SELECT w FROM aims) GROUP BY doc_id, w),
weights AS (SELECT w, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS weight FROM times, whole GROUP BY w, docs),
impacts AS (SELECT doc_id, w, weight * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // all_words))) AS impact FROM times JOIN weights USING (w) JOIN sizes USING (doc_id), whole),
scores AS (SELECT item_id, doc_id, CAST(sum(impact) AS BIGINT) AS score FROM aims JOIN impacts USING (w) GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 50
"""
