"""Importance resampling towards a target table, over word tries that live in one partition each.

A trie's node is a run of consecutive words; it holds how often the run was met and the CRC-32 state of its
bytes, so a longer run's state comes from its parent's and one word more, and a node knows its bucket.  Bucket totals
of all tries are merged by Spark; the gains of buckets (at most as many as there are buckets) then go to all
tasks, whose tries carry them at their nodes, and a document's sum is collected along its paths.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tallyloom.llm.scratch import stash
from tallyloom.llm.textscan import NO_TERM, batches

#: Words a feature has at most, buckets, percent of the documents that are drawn, words of a document that can be.
RUN, BUCKETS, PERCENT, LEAST_WORDS, SEED = 1, 10000, 10, 20, 2024
#: Nodes at which a trie is counted out and begun anew (counts add up, so nothing is lost), bytes of text walked at once.
NODES, WALK = 1 << 18, 1 << 20
#: Drawn rows of a range of ranks.
RANGE = 1 << 20


class Trie:
    """Runs of words; node 0 is the root.  gains: those of the buckets, if nodes shall carry them."""

    def __init__(self, buckets: int, gains: np.ndarray | None = None):
        self.buckets, self.gains = buckets, gains
        self.clear()

    def clear(self) -> None:
        self.word: dict[int, int] = {}  # number of a word, by its hash
        self.spelled: list[bytes] = []
        self.child: dict[int, int] = {}  # node below parent << 32 | word
        self.state, self.count, self.gain = (np.zeros(1024, k) for k in (np.int64, np.int64, np.int64))
        self.size = 1

    def _grow(self, new: list[tuple[int, int]]) -> None:
        """Nodes for (parent, word)."""
        while len(self.state) < self.size + len(new):
            self.state, self.count, self.gain = (np.concatenate((a, np.zeros_like(a))) for a in (self.state, self.count, self.gain))
        for parent, word in new:
            self.state[self.size] = zlib.crc32(b" " + self.spelled[word] if parent else self.spelled[word], int(self.state[parent]))
            self.child[parent << 32 | word] = self.size
            self.size += 1
        if self.gains is not None and new:
            fresh = slice(self.size - len(new), self.size)
            self.gain[fresh] = self.gains[self.state[fresh] % self.buckets]

    def _below(self, parent: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The node of each word below each parent, made where it is new."""
        edge, at = np.unique(parent << 32 | word, return_inverse=True)
        edges = edge.tolist()
        self._grow([(e >> 32, e & 0xFFFFFFFF) for e in edges if e not in self.child])
        return np.array([self.child[e] for e in edges], np.int64)[at]

    def walk(self, t, run: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each length up to run: the nodes of the runs of t's words, and the number of their first word."""
        hashes, first, at = np.unique(t.hashes(t.start, t.end, lower=True), return_index=True, return_inverse=True)
        number = np.zeros(len(hashes), np.int64)
        for i, h in enumerate(hashes.tolist()):
            if h not in self.word:
                self.word[h] = len(self.spelled)
                self.spelled.append(t.data[t.start[first[i]] : t.end[first[i]]].tobytes().lower())  # of bytes: A-Z only
            number[i] = self.word[h]
        word = number[at]
        start, node = np.arange(len(word)), np.zeros(len(word), np.int64)
        for length in range(1, run + 1):
            inside = start + length <= t.first[t.of[start] + 1]
            start, node = start[inside], node[inside]
            node = self._below(node, word[start + length - 1])
            yield node, start

    def add(self, t, run: int) -> None:
        for node, _ in self.walk(t, run):
            times = np.bincount(node)
            self.count[: len(times)] += times

    def totals(self) -> np.ndarray:
        """Features by bucket since the trie was begun."""
        out = np.zeros(self.buckets, np.int64)
        np.add.at(out, self.state[1 : self.size] % self.buckets, self.count[1 : self.size])
        return out

    def sums(self, t, run: int) -> tuple[np.ndarray, np.ndarray]:
        """Features and sum of their gains of each text."""
        n, total = np.zeros(t.n, np.int64), np.zeros(t.n, np.int64)
        for node, start in self.walk(t, run):
            n += np.bincount(t.of[start], minlength=t.n)
            upto = np.concatenate(([0], np.cumsum(self.gain[node])))
            edge = np.searchsorted(start, t.first)
            total += upto[edge[1:]] - upto[edge[:-1]]
        return n, total


def bucket_totals(docs: DataFrame, text: str = "text", *, run: int = RUN, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, n`` of all features of docs; a task gives a row per bucket at most."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, out = Trie(buckets), np.zeros(buckets, np.int64)
        for part in parts:
            for _, _, t in batches(part.column(text), WALK):
                t.words(NO_TERM)
                trie.add(t, run)
                if trie.size > NODES:
                    out += trie.totals()
                    trie.clear()
        out += trie.totals()
        met = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(out[met])], names=["bucket", "n"])

    return docs.select(text).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 * log ratio of the smoothed shares in target and source) of every bucket."""
    all_s, all_t = float(sum(source.values()) + buckets), float(sum(target.values()) + buckets)
    return np.array([math.floor(1000 * math.log((target.get(b, 0) + 1.0) * all_s / ((source.get(b, 0) + 1.0) * all_t))) for b in range(buckets)], np.int64)


def weights(docs: DataFrame, gains: np.ndarray, *, doc_id: str = "doc_id", text: str = "text", run: int = RUN) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` (the floored mean gain, 0 without features) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(gains)  # a number per bucket
    kind = docs.schema[doc_id].dataType.simpleString()

    def score(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(len(shared.value), shared.value)
        for part in parts:
            for lo, hi, t in batches(part.column("text"), WALK):
                t.words(NO_TERM)
                if trie.size > NODES:
                    trie.clear()
                n, total = trie.sums(t, run)
                yield pa.RecordBatch.from_arrays([part.column("doc_id")[lo:hi], *[pa.array(x, pa.int64()) for x in (np.diff(t.first), n, total // np.maximum(n, 1))]], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(score, f"doc_id {kind}, n_words long, n_features long, weight long")


def _ranked(rows: DataFrame, order: list, rank: str) -> DataFrame:
    """rows (a table) with their place, from 1, in the given order: places in ranges, and the ranges' sums of counts."""
    spark = rows.sparkSession
    ranges = 1 + rows.count() // RANGE
    dealt = stash(rows.repartitionByRange(ranges, *order, F.xxhash64(*rows.columns), F.monotonically_increasing_id()).withColumn("_range", F.spark_partition_id()), "ranges")
    before, sums = 0, []
    for r in sorted(dealt.groupBy("_range").count().collect()):  # a row per range
        sums.append((r[0], before))
        before += r[1]
    offsets = F.broadcast(spark.createDataFrame(sums, "_range int, _before long"))
    place = F.row_number().over(W.partitionBy("_range").orderBy(*order, F.xxhash64(*rows.columns)))
    return dealt.withColumn(rank, place).join(offsets, "_range").withColumn(rank, F.col(rank) + F.col("_before")).select(*rows.columns, rank)


def draw(scored: DataFrame, *, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """scored (``doc_id, n_words, score`` and more; a table) with rank: 1 for the highest score, null for what is not drawn.

    The score at the cut comes from counts by score, whose range is that of a few logarithms; only rows from there up
    are put in order, in ranges, so no task sees all of them.  Ties go to the smaller doc_id, a null before all others.
    """
    able = F.col("n_words") >= least_words
    left = wanted = scored.filter(able).count() * percent // 100
    cut = None
    if wanted:
        for r in sorted(scored.filter(able).groupBy("score").count().collect(), reverse=True):
            cut, left = r[0], left - r[1]
            if left <= 0:
                break
    chosen = able & (F.col("score") >= F.lit(cut)) if wanted else F.lit(False)
    ranked = _ranked(scored.filter(chosen), [F.desc("score"), F.asc_nulls_first("doc_id")], "rank") if wanted else scored.filter(chosen).withColumn("rank", F.lit(None).cast("long"))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank").cast("long")))
    return ranked.unionByName(scored.filter(~chosen).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, *, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", run: int = RUN, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` of every row of docs, drawn (rank is not null) towards the features of target.

    Weights take whole texts; noise of the extreme-value kind, made of seed and doc_id, makes the highest scores a draw
    without replacement in proportion to the weights' exponents, and reruns agree.  A null or empty text has no words, weight 0,
    and is not drawn.  Each row is a document: repeated rows have equal scores and ranks of their own.  A null doc_id counts
    as an empty string for the noise and goes first among ties.  Empty docs give an empty result; an empty target leaves a
    weight by how rare the buckets are in docs.  Other columns are not read.
    """
    totals = [{r.bucket: r.n for r in bucket_totals(d, c, run=run, buckets=buckets).collect()} for d, c in ((docs, text), (target, target_text))]  # a row per bucket at most
    found = weights(docs, bucket_gains(*totals, buckets), doc_id=doc_id, text=text, run=run)
    mark = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(mark, 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return draw(stash(found.withColumn("score", F.col("weight") + noise), "scored"), percent=percent, least_words=least_words)


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of all documents, drawn towards the words of the benchmark."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return resample(read("documents"), read("benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 of a word: its table of 256 values by eight steps each, then the word's UTF-8 bytes one by one.
OP12_SQL = r"""
WITH crcs AS (SELECT list_transform(range(256), lambda c: list_reduce(range(8), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(3988292384, v >> 1) ELSE v >> 1 END, c)) AS t),
words AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents),
aims AS (SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
spelled AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM words UNION SELECT w FROM aims)),
buckets AS (SELECT w, xor(list_reduce(list_transform(range(length(x) // 2), lambda i: CAST('0x' || substr(x, CAST(2 * i + 1 AS INT), 2) AS BIGINT)), lambda v, b: xor(t[CAST(xor(v, b) & 255 AS INT) + 1], v >> 8), CAST(4294967295 AS BIGINT)), 4294967295) % 10000 AS b FROM spelled, crcs),
totals AS (SELECT b, sum(s) AS s, sum(t) AS t FROM (SELECT b, count(*) AS s, 0 AS t FROM words JOIN buckets USING (w) GROUP BY b UNION ALL SELECT b, 0, count(*) FROM aims JOIN buckets USING (w) GROUP BY b) GROUP BY b),
gains AS (SELECT b, CAST(floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE))) AS BIGINT) AS gain FROM totals),
sums AS (SELECT doc_id, count(*) AS n, CAST(sum(gain) AS BIGINT) AS total FROM words JOIN buckets USING (w) JOIN gains USING (b) GROUP BY doc_id),
scored AS (SELECT doc_id, coalesce(n, 0) AS n_features, CAST(floor(coalesce(total / n, 0)) AS BIGINT) AS weight, CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS noise FROM documents LEFT JOIN sums USING (doc_id)),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY weight + noise DESC, doc_id) AS r, count(*) OVER () AS able FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, weight + noise AS score, CASE WHEN r <= 10 * able // 100 THEN r END AS rank FROM scored LEFT JOIN ranked USING (doc_id)
"""
