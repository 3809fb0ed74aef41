"""Quality rules, and an isolation forest on their statistics.

The statistics of every document are computed in one pass.  The forest is fitted on a bounded
sample (trees x points, documented below) taken by hash, and its threshold is calibrated on a
bounded number of labelled documents; both then judge all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tallyloom.llm.scratch import stash
from tallyloom.llm.textscan import U, batches, code_points, mix

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
FEATURES = ("word_chars", "symbols", "dup_lines", "repeats")
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, features array<double>"
#: The forest's points and the labelled documents for its threshold are at most so many.
TREES, POINTS, DEPTH, LABELLED = 128, 256, 12, 20000


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each key: whether it occurs twice or more, and whether it has come before."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    later = np.concatenate(([False], same)) if len(keys) else np.zeros(0, bool)
    out = np.zeros((2, len(keys)), bool)
    out[0][order] = later | (np.concatenate((same, [False])) if len(keys) else later)
    out[1][order] = later
    return out[0], out[1]


def statistics(t) -> dict[str, np.ndarray]:
    """The contract's counts of each text, and the features of the forest."""
    t.words()
    t.lines()
    n_words = np.diff(t.first)
    word_chars = t.per_text(t.filled & code_points(t.data))
    symbols = t.per_text(SYMBOL[t.data])
    filled = np.concatenate(([0], np.cumsum(t.filled)))
    full = np.flatnonzero(filled[t.line_end] > filled[t.line_start])
    of = t.line_of[full]
    again = _repeated(mix(t.hashes(t.line_start[full], t.line_end[full]) + of.astype(np.uint64) * U(0x9E3779B97F4A7C15)))[1]
    dup_lines = np.bincount(of[again], minlength=t.n)
    words = t.hashes(t.start, t.end)
    window, at = t.windows(words, 5)
    twice = at[_repeated(mix(window + t.of[at].astype(np.uint64) * U(0x9E3779B97F4A7C15)))[0]]
    cover = np.zeros(len(words) + 6, np.int32)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + 5, -1)
    covered = np.cumsum(cover)[: len(words)] > 0
    repeats = np.bincount(t.of[covered], minlength=t.n)
    lines, per = np.maximum(1, np.bincount(of, minlength=t.n)), np.maximum(1, n_words)
    features = np.column_stack([word_chars / per, np.sqrt(symbols / per), dup_lines / lines, repeats / per])
    return {"n_words": n_words, "word_chars": word_chars, "n_symbols": symbols, "n_dup_lines": dup_lines, "n_repeat_words": repeats, "features": features}


class Forest:
    """Isolation forest: random splits of samples of points; the mean path length to a row's leaf, as 2 ** -(mean / expected).

    Half of the splits are drawn between the node's points, half over the node's part of the box that
    all documents span: the latter leave regions without points, and rows that fall there end early
    even if many rows of the corpus are alike.
    """

    def __init__(self, sample: np.ndarray, box: tuple[np.ndarray, np.ndarray], seed: int = 11, trees: int = TREES, points: int = POINTS, depth: int = DEPTH):
        rng = np.random.Generator(np.random.PCG64(seed))
        points, self.depth = min(points, len(sample)), depth
        nodes: list[tuple] = []
        self.roots = [self._grow(nodes, sample[rng.permutation(len(sample))[:points]], *box, 0, rng) for _ in range(trees)]
        self.dim, self.cut, self.path, self.below, self.above = (np.array(x) for x in zip(*nodes, strict=True))
        self.expected = self._unsplit(points)

    @staticmethod
    def _unsplit(n: int) -> float:
        """Expected further path in a leaf of n points."""
        return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def _grow(self, nodes: list, rows: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int, rng) -> int:
        inside = len(rows) > 1 and rng.random() < 0.5
        low, high = (rows.min(0), rows.max(0)) if inside else (lo, hi)
        wide = np.flatnonzero(high > low)
        me = len(nodes)
        if depth >= self.depth or len(rows) <= 1 or len(wide) == 0:
            nodes.append((-1, 0.0, depth + self._unsplit(len(rows)), me, me))
            return me
        nodes.append(None)
        d = int(rng.choice(wide))
        cut = rng.uniform(low[d], high[d])
        under = rows[:, d] < cut
        top, bottom = hi.copy(), lo.copy()
        top[d] = bottom[d] = cut
        below = self._grow(nodes, rows[under], lo, top, depth + 1, rng)
        above = self._grow(nodes, rows[~under], bottom, hi, depth + 1, rng)
        nodes[me] = (d, cut, 0.0, below, above)
        return me

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1 for each row; higher is more anomalous."""
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                d = self.dim[node]
                node = np.where(x[rows, np.maximum(d, 0)] < self.cut[node], self.below[node], self.above[node])
            total += self.path[node]
        return 2.0 ** (-total / len(self.roots) / max(self.expected, 1e-9))


def threshold(scores: np.ndarray, good: np.ndarray, most_lost: float = 0.002) -> float:
    """The score above which most bad labelled rows lie while at most most_lost of the good ones do; infinite if that separates nothing."""
    if not good.any() or good.all():
        return float("inf")
    least = np.quantile(scores[good], 1 - most_lost, method="higher")
    gap = np.sort(scores[~good & (scores > least)])
    return float((least + gap[0]) / 2) if len(gap) else float("inf")


def _stat_batches(id_column: str, text_column: str):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for lo, hi, t in batches(part.column(text_column)):
                s = statistics(t)
                features = s.pop("features")
                lists = pa.ListArray.from_arrays(np.arange(0, features.size + 1, features.shape[1], dtype=np.int32), features.ravel())
                yield pa.RecordBatch.from_arrays([part.column(id_column)[lo:hi], *[pa.array(v, pa.int64()) for v in s.values()], lists], names=[id_column, *s, "features"])

    return run


def failed_rules() -> Column:
    """Fewer than ten words, or over a fifth of them in repeated five-word windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _lowest(df: DataFrame, key: Column, most: int, *ties: str) -> DataFrame:
    """The ``most`` rows with the lowest hashes, or all; rows beyond the part of the hashes (1 / 4096 each) that has enough are not sorted, so tasks send few."""
    part = F.shiftrightunsigned(key, 52)
    held, last = 0, -1
    for row in sorted(df.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()):  # 4096 rows at most
        held, last = held + row.n, row.part
        if held >= most:
            break
    return df.filter(part <= last).orderBy(F.shiftrightunsigned(key, 1), key, *ties).limit(most)


def fit(stats: DataFrame, labels: DataFrame | None, doc_id: str = "doc_id", seed: int = 11) -> tuple[Forest | None, float]:
    """The forest and its threshold, over documents that pass the rules.

    The box (0.1 % and 99.9 % of each statistic) comes from all of them in one aggregation, the points from the good ones
    among LABELLED labelled documents at most (``doc_id, quality``), which have the lowest hashes, the threshold from all of those.
    An id that is labelled more than once has its lowest label; of rows that repeat a labelled id, the one with the lowest
    statistics counts.  Without labelled good documents nothing is rejected, and there is no forest.
    """
    passing = stats.filter(~failed_rules())
    if labels is None:
        return None, float("inf")
    known = labels.select(F.col(doc_id).alias("_id"), "quality").filter("quality IS NOT NULL AND _id IS NOT NULL").groupBy("_id").agg(F.min("quality").alias("quality"))
    known = _lowest(known, F.xxhash64(F.lit(seed), F.col("_id")), LABELLED, "_id")
    found = passing.join(F.broadcast(known), F.col(doc_id) == F.col("_id")).groupBy("_id").agg(F.min(F.struct("features", "quality")).alias("at"))
    rows = sorted(found.select("_id", "at.*").collect(), key=lambda r: r._id)  # LABELLED rows at most; the order of rows must not decide on the points
    good = np.array([r.quality == 1 for r in rows], bool)
    if not good.any():
        return None, float("inf")
    ends = passing.agg(*[F.percentile_approx(F.col("features")[i], F.array(F.lit(0.001), F.lit(0.999)), F.lit(20000)) for i in range(len(FEATURES))]).first()
    box = tuple(np.array([e[k] for e in ends]) for k in (0, 1))
    y = np.array([r.features for r in rows])
    forest = Forest(y[good], box, seed)
    return forest, threshold(forest.score(y), good)


def judge(stats: DataFrame, forest: Forest | None, limit: float) -> DataFrame:
    """stats with ``base_failed, score, kept``."""
    share = stats.sparkSession.sparkContext.broadcast(forest)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            x = np.array(part.column("features").flatten(), float).reshape(part.num_rows, -1) if part.num_rows else np.zeros((0, len(FEATURES)))
            score = share.value.score(x) if share.value is not None else np.zeros(part.num_rows)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score, pa.float64())], names=[*part.schema.names, "score"])

    failed = failed_rules()
    scored = stats.mapInArrow(run, T.StructType([*stats.schema.fields, T.StructField("score", T.DoubleType())]))
    return scored.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") <= F.lit(limit)))


def text_stats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The statistics of every row of docs: ``doc_id`` and STATS.  A null text has no words; other columns are not read."""
    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(_stat_batches(doc_id, text), f"`{doc_id}` {kind}, {STATS}")


def quality(docs: DataFrame, labels: DataFrame | None = None, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: the rules' statistics, ``base_failed``, the forest's ``score``, and ``kept``.

    Without labels, or labels of one class only, the forest rejects nothing.  Null and empty texts fail the rules; long texts are
    read to their end; documents of equal statistics have equal scores, and a score at the limit is kept;
    null ids and repeated rows are judged like others; an empty table gives an empty result.
    """
    stats = stash(text_stats(docs, doc_id, text), "quality-stats")
    return judge(stats, *fit(stats, labels, doc_id))


def keep_good(docs: DataFrame, labels: DataFrame | None, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that the rules and the forest keep, with their columns, whatever their names.

    Texts are scanned twice (to fit, to judge) and not shuffled; the rows come from a written table, so that Python gets few of them at once.  Null and empty texts go, as they have no words; rows with
    null ids and repeated rows are judged each; an empty table gives an empty result.
    """
    model, limit = fit(stash(text_stats(docs, doc_id, text), "quality-stats"), labels, doc_id)
    share = docs.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            keep = []
            for _, _, t in batches(part.column(text)):
                s = statistics(t)
                failed = (s["n_words"] < 10) | (100 * s["n_repeat_words"] > 20 * s["n_words"])
                keep.append(~failed & ((share.value.score(s["features"]) <= limit) if share.value is not None else True))
            yield part.filter(pa.array(np.concatenate(keep))) if keep else part

    return stash(docs.mapInArrow(run, docs.schema), "quality-kept")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule statistics and verdict of every document; the threshold comes from the labels table."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality(docs, labels).drop("features")
