"""Exact Jaccard join of documents on word shingles with adaptive multi-match prefixes.

* Documents with equal shingle sets form one class; the join runs on classes.
* Shingles have one global order: those in few documents by hash, then the common ones: by hash if only
  a Bloom filter tells of them, and the most frequent by document frequency.  Any order is exact;
  frequencies, counted over all documents, make it sharp.  No common shingle passes for a rare one.
* A document that may miss m shingles of a partner shares at least l of its first m + l shingles with
  it.  Each document picks the l with the least estimated cost: postings scanned, and candidates left
  for verification.  A pair must share the lesser l of its two prefixes before it is verified.
* Postings of rare shingles are short and joined as they are.  Postings of common shingles can hold a
  group of near copies of any size; there each document first meets one leader, the one with
  the fewest rare shingles, and only documents that are still in other components than their
  posting's largest one are joined further.  Pairs within a component are never enumerated.
* Verification intersects whole shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyloom.llm.components import components
from tallyloom.llm.frequent import most_frequent
from tallyloom.llm.scratch import stash
from tallyloom.llm.textscan import U, batches, mix

#: A shingle in so many documents is common; at most so many common shingles (the most frequent) are told to all tasks by name, all others by a
#: Bloom filter of so many bits at most (a fuller filter only calls more rare shingles common).
COMMON, TOLD, BLOOM = 32, 1 << 20, 1 << 28
PROBES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)
#: Tokens per group when frequencies are counted; the longest extension of a prefix; cost of verifying a pair in postings scanned.
GROUP, LONGEST, VERIFY = 1 << 20, 16, 16
FIRST = -(2**63)


def shingle_sets(t, words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; all words as one shingle if there are fewer."""
    t.words()
    h = t.hashes(t.start, t.end, lower=True)
    shingles, at = t.windows(h, words)
    bound = np.searchsorted(t.of[at], np.arange(t.n + 1))
    short = np.diff(t.first)
    out = []
    for i in range(t.n):
        if bound[i + 1] > bound[i]:
            out.append(np.unique(shingles[bound[i] : bound[i + 1]]))
        elif short[i]:
            one = U(short[i])
            for x in h[t.first[i] : t.first[i + 1]]:
                one = mix(np.array([one], np.uint64) * U(0x9E3779B97F4A7C15) ^ x)[0]
            out.append(np.array([one], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _signatures(words: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for lo, hi, t in batches(part.column("text")):
                sets = shingle_sets(t, words)
                sums = [np.array([mix(s * U(k)).sum(dtype=np.uint64) for s in sets], np.uint64) for k in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
                yield pa.RecordBatch.from_arrays([part.column("id")[lo:hi], pa.array([len(s) for s in sets], pa.int64()), *[pa.array(_signed(s)) for s in sums]], names=["id", "n", "s1", "s2"])

    return run


def _counts(words: int, bits: int):
    """Rows (group, tokens, counts): of a run of documents, the distinct 50-bit tokens by their first bits, and in how many documents each is."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            token, count = np.unique(np.concatenate(held) >> U(14), return_counts=True)
            group = (token >> U(50 - bits)).astype(np.int64)
            edge = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True])))
            rest = (token & ((U(1) << U(50 - bits)) - U(1))).view(np.uint8).reshape(-1, 8)[:, : (57 - bits) // 8].tobytes()
            wide = (57 - bits) // 8
            times = np.minimum(count, 65535).astype("<u2").tobytes()
            return pa.RecordBatch.from_arrays([pa.array(group[edge[:-1]]), pa.array([rest[a * wide : b * wide] for a, b in zip(edge, edge[1:])], pa.binary()), pa.array([times[a * 2 : b * 2] for a, b in zip(edge, edge[1:])], pa.binary())], names=["group", "tokens", "counts"])

        for part in parts:
            for _, _, t in batches(part.column("text")):
                for s in shingle_sets(t, words):
                    held.append(s)
                    size += len(s)
                if size > 1 << 20:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return run


def _common(bits: int, least: int):
    wide = (57 - bits) // 8

    def run(table: pa.Table) -> pa.Table:
        group = table.column("group")[0].as_py()
        raw = b"".join(table.column("tokens").to_pylist())
        token = np.zeros((len(raw) // wide, 8), np.uint8)
        token[:, :wide] = np.frombuffer(raw, np.uint8).reshape(-1, wide)
        token = token.view(np.uint64).ravel()
        times = np.frombuffer(b"".join(table.column("counts").to_pylist()), "<u2").astype(np.int64)
        order = np.argsort(token, kind="stable")
        token, times = token[order], times[order]
        first = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
        total = np.add.reduceat(times, first)
        often = total >= least
        return pa.table({"token": pa.array((token[first][often] | U(group << (50 - bits))).astype(np.int64)), "df": pa.array(total[often])})

    return run


def choose(weights: np.ndarray, miss: int) -> int:
    """The l for a document whose shingles, in order, have postings of these lengths: least cost of scanning m + l postings and verifying what matches l times."""
    most = min(LONGEST, len(weights) - miss)
    scanned = np.cumsum(weights[: miss + most])[miss:]
    return int(np.argmin(scanned * (1 + VERIFY / np.arange(1, most + 1)))) + 1


def _positions(token: np.ndarray, bits: int) -> list[np.ndarray]:
    """Places of 50-bit tokens in a filter of 2**bits bits."""
    return [(mix(token.astype(np.uint64) * U(k)) >> U(64 - bits)).astype(np.int64) for k in PROBES]


def bloom(tokens: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter of 2**bits bits (six at least) of the column token, as 64-bit words.

    Tasks give the words in which they set bits, which are joined by bitwise or; the driver gets one row per word at most.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            at = np.unique(np.concatenate(_positions(part.column("token").to_numpy(), bits)))
            word, first = np.unique(at >> 6, return_index=True)
            value = np.bitwise_or.reduceat(U(1) << (at & 63).astype(np.uint64), first) if len(at) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(word, pa.int64()), pa.array(value.view(np.int64))], names=["word", "bits"])

    out = np.zeros(1 << (bits - 6), np.uint64)
    found = tokens.select("token").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def _held(words: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Whether a filter may hold the tokens; it holds all that it was made of."""
    out = np.ones(len(token), bool)
    for at in _positions(token, len(words).bit_length() + 5):
        out &= (words[at >> 6] >> (at & 63).astype(np.uint64) & U(1)).astype(bool)
    return out


def _prefixes(words: int, num: int, den: int, told):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, df, others = told.value
        for part in parts:
            for lo, hi, t in batches(part.column("text")):
                rows: dict[str, list] = {k: [] for k in ("n", "extra", "rare", "light", "heavy")}
                for s in shingle_sets(t, words):
                    n, name = len(s), (s >> U(14)).astype(np.int64)
                    at = np.minimum(np.searchsorted(token, name), max(0, len(token) - 1))
                    known = token[at] == name if len(token) else np.zeros(n, bool)
                    count = np.where(known, df[at], 2 * COMMON) if len(token) else np.full(n, 2 * COMMON)
                    heavy = known if others is None else known | _held(others, name)
                    often = np.flatnonzero(heavy)
                    often = often[np.lexsort((s[often], count[often], known[often]))]
                    light = s[~heavy]
                    miss = n - -(-num * n // den)
                    extra = choose(np.concatenate((np.full(len(light), 2), count[often])), miss) if n else 0
                    length = miss + extra if n else 0
                    rows["n"].append(n)
                    rows["extra"].append(extra)
                    rows["rare"].append(len(light))
                    rows["light"].append(_signed(light[:length]))
                    rows["heavy"].append(_signed(s[often[: max(0, length - len(light))]]))
                lists = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("id")[lo:hi], *[pa.array(rows[k], pa.int64()) for k in ("n", "extra", "rare")], *[pa.array(rows[k], lists) for k in ("light", "heavy")]], names=["id", *rows])

    return run


def _sets(words: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for lo, hi, t in batches(part.column("text")):
                yield pa.RecordBatch.from_arrays([part.column("id")[lo:hi], pa.array([_signed(s) for s in shingle_sets(t, words)], pa.list_(pa.int64()))], names=["id", "shingles"])

    return run


def _alike(n: Column, m: Column, num: int, den: int) -> Column:
    return F.least(n, m) * den >= F.greatest(n, m) * num


class Join:
    """The steps of the join over docs ``id, text`` (ids are not null)."""

    def __init__(self, docs: DataFrame, words: int, num: int, den: int):
        self.docs, self.words, self.num, self.den = docs, words, num, den
        self.spark = docs.sparkSession

    def run(self) -> DataFrame:
        """``id, n_shingles, component`` of every row."""
        every = stash(self.docs.mapInArrow(_signatures(self.words), "id long, n long, s1 long, s2 long"), "signatures")
        sign = ["n", "s1", "s2"]
        classes = stash(every.filter("n > 0").groupBy(*sign).agg(F.min("id").alias("rep")), "classes", every)
        self.prefixes = stash(self._prefixes(every).join(classes.select(F.col("rep").alias("id")).distinct(), "id", "left_semi"), "prefixes")
        links = self._verify(stash(self._rare().unionByName(self._leaders()).distinct(), "pairs", self.prefixes))
        label = components(links)
        if more := self._rest(label):
            known = label.filter("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b"))
            label = components(known.unionByName(self._verify(more)))
        label = label.select(F.col("id").alias("rep"), "component")
        out = every.join(classes.join(label, "rep", "left"), sign, "left")
        return out.select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "id").alias("component"))

    def _prefixes(self, every: DataFrame) -> DataFrame:
        total = every.agg(F.sum("n")).first()[0] or 0
        bits = max(6, min(40, int(total // GROUP).bit_length()))
        counted = self.docs.select("text").mapInArrow(_counts(self.words, bits), "group long, tokens binary, counts binary")
        common = stash(counted.groupBy("group").applyInArrow(_common(bits, COMMON), "token long, df long"), "common")
        told = most_frequent(common, "df", TOLD, "token").toArrow()  # TOLD rows at most
        token, df = (told.column(k).to_numpy().astype(np.int64) for k in ("token", "df"))
        others = common.count() - len(token)
        filter_ = bloom(common, max(6, min(BLOOM.bit_length() - 1, (16 * others).bit_length()))) if others else None
        order = np.argsort(token)
        shared = self.spark.sparkContext.broadcast((token[order], df[order], filter_))
        return self.docs.mapInArrow(_prefixes(self.words, self.num, self.den, shared), "id long, n long, extra long, rare long, light array<bigint>, heavy array<bigint>")

    def _rare(self) -> DataFrame:
        """Pairs that share a rare shingle of both prefixes: no posting here is longer than COMMON."""
        side = lambda s: self.prefixes.select(F.explode("light").alias("token"), F.col("id").alias(s), F.col("n").alias(f"n_{s}"))
        joined = side("a").join(side("b"), "token").filter((F.col("a") < F.col("b")) & _alike(F.col("n_a"), F.col("n_b"), self.num, self.den))
        return joined.select("a", "b").distinct()

    def _postings(self) -> DataFrame:
        """Common shingles of documents that can have a partner: without its rare shingles, enough are left.

        A partner that shares none of the rare shingles shares one of the first (m - rare + 1) common ones; no
        more are posted, and ``prefix`` serves to count matches in all of both prefixes.
        """
        able = self.prefixes.filter((F.size("heavy") > 0) & ((F.col("n") - F.col("rare")) * self.den >= F.col("n") * self.num))
        miss = F.col("n") - F.floor((F.col("n") * self.num + self.den - 1) / self.den)
        posted = F.slice("heavy", F.lit(1), (miss - F.col("rare") + 1).cast("int"))
        able = able.select("id", "n", "rare", "extra", posted.alias("posted"), F.concat("light", "heavy").alias("prefix"))
        return able.select(F.explode("posted").alias("token"), "id", "n", "rare", "extra", "prefix")

    def _leaders(self) -> DataFrame:
        """Each document of a common posting with the posting's leader among documents of about its size."""
        size = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(1 + (self.den - self.num) / self.den / 2)))).alias("size")
        rows = self._postings().select("token", "id", "n", "rare", size)
        lead = stash(rows.groupBy("token", "size").agg(F.min(F.struct("rare", "id", "n")).alias("lead")), "leaders", self.prefixes)
        near = rows.join(lead, ["token", "size"]).filter((F.col("id") != F.col("lead.id")) & _alike(F.col("n"), F.col("lead.n"), self.num, self.den))
        # the leaders of neighbouring sizes meet too
        up = lead.select("token", (F.col("size") + 1).alias("size"), F.col("lead").alias("low"))
        across = lead.join(up, ["token", "size"]).filter((F.col("lead.id") != F.col("low.id")) & _alike(F.col("lead.n"), F.col("low.n"), self.num, self.den))
        pair = lambda x, y: [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]
        return near.select(*pair("id", "lead.id")).distinct().unionByName(across.select(*pair("lead.id", "low.id")).distinct())

    def _rest(self, label: DataFrame) -> DataFrame | None:
        """Pairs of common postings whose documents are not yet in one component; none if all postings are settled.

        Such a pair shares no rare shingle (else it was met before, as prefixes with common shingles hold all
        rare ones), so it shares at most what both have left without theirs.  Of postings with the same documents (the
        shingles of a passage that they share) one is joined, and only with documents of sizes that can be alike: the key is
        the posting and a step of sizes, of which alike ones lie in the same or in neighbouring steps.  The join itself
        counts the matches of both prefixes, and gives a pair at its least common posting only.
        """
        rows = self._postings().join(label.select("id", "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
        sums = [F.sum(F.xxhash64(F.lit(k), "id").cast("decimal(38,0)")).alias(f"s{k}") for k in (1, 2)]
        groups = rows.groupBy("token", "component").agg(F.count("*").alias("k"), *sums)
        groups = groups.groupBy("token").agg(F.max_by("component", F.struct("k", "component")).alias("main"), F.count("*").alias("kinds"), F.sum("k").alias("k"), *[F.sum(f"s{k}").alias(f"s{k}") for k in (1, 2)])
        groups = groups.filter("kinds > 1").groupBy("k", "s1", "s2").agg(F.min(F.struct("token", "main")).alias("at")).select("at.*")
        groups = stash(groups, "mixed", self.prefixes)  # as a table, so that the join's hot keys can be split
        step = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(self.den / self.num)) + 1e-9)).alias("step")
        rows = rows.join(groups, "token").select("*", step)
        kept = rows.groupBy("id").agg(F.collect_set("token").alias("kept"))  # no more than the document's prefix has
        rows = stash(rows.join(kept, "id"), "unsettled", self.prefixes)
        if rows.isEmpty():
            return None
        steps = F.explode(F.array(*[F.col("step") + F.lit(k) for k in (-1, 0, 1)])).alias("step")
        other = rows.filter("component <> main").select("token", steps, F.col("id").alias("x"), F.col("n").alias("n_x"), F.col("rare").alias("rare_x"), F.col("component").alias("c_x"), F.col("extra").alias("extra_x"), F.col("kept").alias("kept_x"), F.col("prefix").alias("prefix_x"))
        shared = F.least(F.col("n") - F.col("rare"), F.col("n_x") - F.col("rare_x"))
        able = (shared * (self.num + self.den) >= (F.col("n") + F.col("n_x")) * self.num) & _alike(F.col("n"), F.col("n_x"), self.num, self.den)
        enough = F.size(F.array_intersect("prefix", "prefix_x")) >= F.least("extra", "extra_x")
        once = F.array_min(F.array_intersect("kept", "kept_x")) == F.col("token")
        pairs = rows.join(other, ["token", "step"]).filter((F.col("component") != F.col("c_x")) & able & once & enough)
        return stash(pairs.select(F.least("id", "x").alias("a"), F.greatest("id", "x").alias("b")).distinct(), "pairs", self.prefixes)

    def _verify(self, pairs: DataFrame) -> DataFrame:
        """The pairs that share enough of their prefixes and then of their whole sets, as written links."""
        part = lambda s: self.prefixes.select(F.col("id").alias(s), F.col("extra").alias(f"extra_{s}"), F.concat("light", "heavy").alias(f"prefix_{s}"))
        enough = F.size(F.array_intersect("prefix_a", "prefix_b")) >= F.least("extra_a", "extra_b")
        pairs = stash(pairs.join(part("a"), "a").join(part("b"), "b").filter(enough).select("a", "b").distinct(), "candidates", pairs, self.prefixes)
        wanted = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
        sets = stash(self.docs.join(wanted, "id", "left_semi").mapInArrow(_sets(self.words), "id long, shingles array<bigint>"), "sets")
        side = lambda s: sets.select(F.col("id").alias(s), F.col("shingles").alias(f"set_{s}"))
        both = F.size(F.array_intersect("set_a", "set_b"))
        union = F.size("set_a") + F.size("set_b") - both
        joined = pairs.join(side("a"), "a").join(side("b"), "b")
        return stash(joined.filter(both.cast("long") * self.den >= union.cast("long") * self.num).select("a", "b"), "verified", pairs, sets)


def jaccard_components(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row: documents are linked if den * intersection >= num * union.

    Documents without words (null or empty text) have no shingles and are linked with nothing.  Rows that repeat
    a doc_id are one document, linked with each other where they have words; a null doc_id is one document, smaller
    than all others, whose component_id is null; doc_ids must be numbers.  An empty table gives an empty result; other columns are not read.
    """
    plain = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(FIRST)).alias("id"), F.col(text).alias("text"))
    out = Join(plain, words, num, den).run()
    real = lambda c: F.when(F.col(c) != FIRST, F.col(c))
    return out.select(real("id").alias("doc_id"), "n_shingles", real("component").alias("component_id"))


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs with only the document of the least doc_id of each component.

    Rows that repeat a doc_id stay or go together; documents without words stay; a null doc_id is smaller than all
    others, so its row stays; an empty table gives an empty result; columns of any name stay as they are.
    """
    found = jaccard_components(docs, doc_id=doc_id, text=text, **options)
    name = "_gone"
    while name in docs.columns:
        name += "_"
    gone = stash(found.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(name)).distinct(), "near-copies")
    return docs.join(gone, F.col(doc_id).cast("long").eqNullSafe(F.col(name)), "left_anti")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents linked at nine tenths of their three-word shingles."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=3, num=90, den=100)
