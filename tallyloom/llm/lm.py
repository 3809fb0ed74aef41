"""Language-model scores of whole documents: unigram counts of the whole training corpus, and a gated recurrent model.

Counts.  Words are 64-bit keys.  Tasks count their words by numpy, deal them in sorted runs by key range, and
ranges are merged; the most frequent words (HEAD at most) are told to all tasks, all others are looked
up by a join of key ranges.

Model.  Symbols are the WORDS most frequent words, four kinds of other words (by shape), and the end.  Other
words have their kind's probability times their add-one share of it, so all texts have a
probability.  A first sample, written as a table, sets where replicas begin; then replicas train on shards
of all training documents, in one epoch, and their weights are averaged, weighted by tokens, FAN at a time.

Scoring.  Every document is one sequence with its state carried from the first to the last token.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyloom.llm.recurrent import Gru, train
from tallyloom.llm.scratch import stash
from tallyloom.llm.textscan import U, batches

HEAD, WORDS, KINDS = 1 << 18, 4096, 4
#: Tokens a replica has at least, about; tokens of the first sample, about; replicas that are averaged by one task.
REPLICA, SEED_TOKENS, FAN = 1 << 17, 1 << 17, 16
RANGE_BYTES = 16 << 20
#: Bytes of texts that are scored side by side.
BESIDE = 12 << 20
PUNCT = np.isin(np.arange(256), list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"))
LN10 = math.log(10)
BINS = 32


def keys(t) -> np.ndarray:
    """A key of each word of the texts, its last two bits the word's kind: other than ASCII or not, ends in punctuation or not."""
    t.words()
    wide = np.concatenate(([0], np.cumsum(t.data >= 128)))
    kind = 2 * (wide[t.end] > wide[t.start]) + PUNCT[t.data[t.end - 1]]
    return (t.hashes(t.start, t.end, lower=True) & ~U(3)) | kind.astype(np.uint64)


def _runs(key: np.ndarray, bits: int, **columns: np.ndarray) -> pa.RecordBatch:
    """Rows (range, keys, columns...) of the key ranges of sorted keys."""
    part = (key >> U(64 - bits)).astype(np.int64)
    edge = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True])))
    blobs = {"keys": key, **columns}
    return pa.RecordBatch.from_arrays([pa.array(part[edge[:-1]]), *[pa.array([v[a:b].tobytes() for a, b in zip(edge, edge[1:])], pa.binary()) for v in blobs.values()]], names=["range", *blobs])


def _count(bits: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            key, n = np.unique(np.concatenate(held), return_counts=True)
            return _runs(key, bits, counts=n)

        for part in parts:
            for _, _, t in batches(part.column("text")):
                held.append(keys(t))
                size += len(held[-1])
                if size > 1 << 20:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return run


def _merge(table: pa.Table) -> pa.Table:
    key = np.frombuffer(b"".join(table.column("keys").to_pylist()), np.uint64)
    n = np.frombuffer(b"".join(table.column("counts").to_pylist()), np.int64)
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return pa.table({"range": table.column("range")[:1], "keys": pa.array([key[first].tobytes()], pa.binary()), "counts": pa.array([np.add.reduceat(n, first).tobytes()], pa.binary())})


def _bin(n: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(n) * BINS).astype(np.int64)


def _histogram(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per kind and bin of the count: types and tokens."""
    total = np.zeros((2, KINDS, 64 * BINS), np.int64)
    for part in parts:
        for k, n in zip(part.column("keys"), part.column("counts"), strict=True):
            kind, n = np.frombuffer(k.as_py(), np.uint64) & U(3), np.frombuffer(n.as_py(), np.int64)
            np.add.at(total[0], (kind, _bin(n)), 1)
            np.add.at(total[1], (kind, _bin(n)), n)
    kind, at = np.nonzero(total[0])
    yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(at), pa.array(total[0][kind, at]), pa.array(total[1][kind, at])], names=["kind", "bin", "types", "tokens"])


def _frequent(least: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for k, n in zip(part.column("keys"), part.column("counts"), strict=True):
                key, n = np.frombuffer(k.as_py(), np.uint64), np.frombuffer(n.as_py(), np.int64)
                often = _bin(n) >= least
                yield pa.RecordBatch.from_arrays([pa.array(key[often].view(np.int64)), pa.array(n[often])], names=["key", "n"])

    return run


class Model:
    """What all tasks need: counts of the head, totals, and the recurrent model's weights."""

    def __init__(self, key: np.ndarray, n: np.ndarray, docs: int, types: np.ndarray, tokens: np.ndarray, words: int = WORDS, hidden: int = 32):
        order = np.argsort(key)
        self.key, self.n = key[order], n[order]
        top = np.lexsort((self.key, -self.n))[:words]
        self.symbol = np.full(len(key), -1, np.int64)
        self.symbol[top] = np.arange(len(top))
        self.words, self.hidden, self.end = len(top), hidden, len(top) + KINDS
        self.docs = docs
        self.total, self.types = int(tokens.sum()) + docs, int(types.sum()) + (docs > 0)
        self.lower = math.log10(self.total + self.types + 1)
        kind = (self.key[top] & U(3)).astype(np.int64)
        other = tokens - np.bincount(kind, weights=self.n[top], minlength=KINDS).astype(np.int64)
        self.other_lower = np.log10(other + types - np.bincount(kind, minlength=KINDS) + 1.0)
        self.counts = np.concatenate((self.n[top], other, [docs]))
        # keys are hashes: their first bits tell where to look; a last key that no word counts under ends each search
        self.shift = np.uint64(64 - max(1, len(key).bit_length()))
        self.begin = np.searchsorted(self.key, np.arange(1 << (64 - int(self.shift)), dtype=np.uint64) << self.shift)
        self.key, self.n, self.symbol = np.append(self.key, ~U(0)), np.append(self.n, -1), np.append(self.symbol, -1)
        self.weights = self.gru().pack()

    def gru(self) -> Gru:
        return Gru(self.counts, self.words, self.hidden)

    def look_up(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count (-1: not in the head) and symbol of each key."""
        at = self.begin.take((key >> self.shift).astype(np.int64))
        ahead = np.flatnonzero(self.key.take(at) < key)
        while len(ahead):
            at[ahead] += 1
            ahead = ahead[self.key.take(at[ahead]) < key[ahead]]
        hit = self.key.take(at) == key
        symbol = np.where(hit, self.symbol.take(at), -1)
        return np.where(hit, self.n.take(at), -1), np.where(symbol >= 0, symbol, self.words + (key & U(3)).astype(np.int64))


def _sequences(t, symbol: np.ndarray, end: int) -> list[np.ndarray]:
    return [np.append(symbol[a:b], end) for a, b in zip(t.first, t.first[1:])]


def _learn(shared, rate: float):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        model = shared.value
        gru = model.gru()
        gru.unpack(model.weights)
        seen, held, size = 0, [], 0

        def learn() -> None:
            stream = np.concatenate(held)
            fresh = np.zeros(len(stream), bool)
            fresh[np.cumsum([0] + [len(x) for x in held[:-1]])] = True
            train(gru, stream, fresh, model.end, rate=rate)

        for part in parts:
            for _, _, t in batches(part.column("text")):
                more = _sequences(t, model.look_up(keys(t))[1], model.end)
                held += more
                size += sum(map(len, more))
                if size >= 2 * REPLICA:
                    learn()
                    seen, held, size = seen + size, [], 0
        if size:
            learn()
        if seen + size:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([float(seen + size)]), pa.array([gru.pack()], pa.binary())], names=["replica", "weight", "weights"])

    return run


AVERAGED = "replica long, weight double, weights binary"


def _average(table: pa.Table) -> pa.Table:
    """One row of some replicas: their weights' mean by tokens, and all their tokens."""
    table = table.sort_by("replica")  # sums do not depend on the order of rows
    total, weight = 0.0, 0.0
    for w, blob in zip(table.column("weight").to_pylist(), table.column("weights"), strict=True):
        total, weight = total + w * np.frombuffer(blob.as_py(), np.float32).astype(np.float64), weight + w
    return pa.table({"replica": pa.array([table.column("replica")[0].as_py() // FAN]), "weight": pa.array([weight]), "weights": pa.array([(total / weight).astype(np.float32).tobytes()], pa.binary())})


def average(found: DataFrame, replicas: int) -> bytes | None:
    """The mean of the weights of replicas ``replica, weight, weights`` numbered below replicas, FAN of them in a task; none without rows."""
    while replicas > 1:
        found = stash(found.groupBy(F.expr(f"replica div {FAN}").alias("_part")).applyInArrow(_average, AVERAGED), "averages")
        replicas = -(-replicas // FAN)
    rows = found.select("weights").take(1)
    return bytes(rows[0].weights) if rows else None


def _score(shared, bits: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        model = shared.value
        gru = model.gru()
        gru.unpack(model.weights)
        row = TaskContext.get().partitionId() << 33
        rare, rows, size = [], [], 0
        none = lambda kind, n: pa.nulls(n, kind)

        def flush() -> pa.RecordBatch:
            key, at = np.concatenate(rare), np.concatenate(rows)
            order = np.argsort(key, kind="stable")
            runs = _runs(key[order], bits, rows=at[order])
            n = runs.num_rows
            return pa.RecordBatch.from_arrays([none(pa.int64(), n), none(ids, n), none(pa.bool_(), n), *[none(pa.int64(), n)] * 2, *[none(pa.float64(), n)] * 2, *runs.columns], names=names)

        names = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "range", "keys", "rows"]
        waiting: list[tuple] = []  # texts whose model probabilities are still to come, and their other columns

        def score() -> Iterator[pa.RecordBatch]:
            p = np.array([x.sum() for x in gru.score([x for texts, *_ in waiting for x in texts], model.end)]) / LN10
            at = 0
            for texts, columns, inner in waiting:
                n = len(texts)
                yield pa.RecordBatch.from_arrays([*columns, pa.array(p[at : at + n] + inner), none(pa.int64(), n), none(pa.binary(), n), none(pa.binary(), n)], names=names)
                at += n
            waiting.clear()

        weight = 0
        for part in parts:
            ids = part.column("doc_id").type
            for lo, hi, t in batches(part.column("text"), 2 << 20):
                key = keys(t)
                n, symbol = model.look_up(key)
                ends = np.log10(model.docs + 1.0)
                base = np.where(n >= 0, np.log10(np.maximum(n, 0) + 1.0), 0.0)
                other = symbol >= model.words
                inner = np.where(other, base - model.other_lower[np.where(other, symbol - model.words, 0)], 0.0)
                per = lambda x: np.bincount(t.of, weights=x, minlength=t.n)
                size_of = np.diff(t.first) + 1
                first = row + np.arange(t.n)
                out = [pa.array(first), part.column("doc_id")[lo:hi], part.column("held_out")[lo:hi], pa.array(size_of), pa.array((per(n > 0) + (model.docs > 0)).astype(np.int64)), pa.array(per(base) + ends - size_of * model.lower)]
                waiting.append((_sequences(t, symbol.astype(np.int32), model.end), out, per(inner)))
                away = np.flatnonzero(n < 0)
                rare.append(key[away])
                rows.append(first[t.of[away]])
                size += len(away)
                row += t.n
                weight += len(t.data)
                if weight >= BESIDE:
                    yield from score()
                    weight = 0
                if size > 1 << 19:
                    yield flush()
                    rare, rows, size = [], [], 0
        if waiting:
            yield from score()
        if size:
            yield flush()

    return run


def _rare(left: pa.Table, right: pa.Table) -> pa.Table:
    """Per row of the documents: sum of log10(count + 1) over its words of a key range that are not in the head, and how many of them are known."""
    key = np.frombuffer(b"".join(left.column("keys").to_pylist()), np.uint64)
    row = np.frombuffer(b"".join(left.column("rows").to_pylist()), np.int64)
    known = np.frombuffer(b"".join(right.column("keys").to_pylist()), np.uint64)
    n = np.frombuffer(b"".join(right.column("counts").to_pylist()), np.int64)
    count = np.zeros(len(key), np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, key), len(known) - 1)
        count = np.where(known[at] == key, n[at], 0)
    rows, at = np.unique(row, return_inverse=True)
    return pa.table({"row": pa.array(rows, pa.int64()), "more": pa.array(np.bincount(at, weights=np.log10(count + 1.0), minlength=len(rows)), pa.float64()), "also": pa.array(np.bincount(at, weights=count > 0, minlength=len(rows)).astype(np.int64))})


def held_out(doc_id: Column, parts: int = 7, part: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def language_scores(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, hidden: int = 32) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row of docs, in log10.

    A null or empty text is its end token alone; a null doc_id is never held out; repeated rows count and are
    scored each; without any training document all counts are 0; an empty table gives an empty result; other
    columns are not read.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), held_out(F.col(doc_id)).alias("held_out"))
    learned = docs.filter(~F.col("held_out"))
    size, n_docs = learned.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    bits = max(4, int((size or 0) // RANGE_BYTES).bit_length())
    counted = learned.select("text").mapInArrow(_count(bits), "range long, keys binary, counts binary")
    vocabulary = stash(counted.groupBy("range").applyInArrow(_merge, "range long, keys binary, counts binary"), "vocabulary")
    bins = vocabulary.select("keys", "counts").mapInArrow(_histogram, "kind long, bin long, types long, tokens long").groupBy("kind", "bin").agg(F.sum("types").alias("types"), F.sum("tokens").alias("tokens")).collect()  # KINDS * 64 * BINS rows at most
    types, tokens, at = np.zeros(KINDS, np.int64), np.zeros(KINDS, np.int64), np.zeros(64 * BINS, np.int64)
    for r in bins:
        types[r.kind] += r.types
        tokens[r.kind] += r.tokens
        at[r.bin] += r.types
    above = np.cumsum(at[::-1])[::-1]
    least = int(np.argmax(above <= HEAD))
    head = vocabulary.select("keys", "counts").mapInArrow(_frequent(least), "key long, n long").toArrow()  # HEAD rows at most
    model = Model(head.column("key").to_numpy().view(np.uint64), head.column("n").to_numpy(), n_docs, types, tokens, words, hidden)

    def learn(rows: DataFrame, replicas: int, rate: float) -> None:
        shards = rows.select("text").coalesce(replicas)
        replicas = shards.rdd.getNumPartitions()
        found = stash(shards.mapInArrow(_learn(spark.sparkContext.broadcast(model), rate), AVERAGED), "replicas")
        model.weights = average(found, replicas) or model.weights

    if model.total:
        first = F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(1 << 20)) < F.lit(int(min(1.0, SEED_TOKENS / model.total) * (1 << 20)))
        learn(stash(learned.filter(first), "lm-first"), 1, 0.01)
        learn(learned, max(1, int(model.total / REPLICA)), 0.005)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double, range long, keys binary, rows binary"
    scored = stash(docs.mapInArrow(_score(spark.sparkContext.broadcast(model), bits), schema), "lm-scores")
    rare = scored.filter("row IS NULL").select("range", "keys", "rows")
    more = rare.groupBy("range").cogroup(vocabulary.groupBy("range")).applyInArrow(_rare, "row long, more double, also long").groupBy("row").agg(F.sum("more").alias("more"), F.sum("also").alias("also"))
    rows = scored.filter("row IS NOT NULL").join(more, "row", "left")
    more_score, also = F.coalesce("more", F.lit(0.0)), F.coalesce("also", F.lit(0))
    return rows.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + also).alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"), (F.col("base") + more_score).alias("base_score"), (F.col("score") + more_score).alias("score"))


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and recurrent-model scores of all documents."""
    return language_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
