"""Near-duplicates by fast similarity sketches, banding, and verification on whole shingle sets.

A sketch has COORDINATES bins.  In round i every shingle of a document is placed by a hash of its own: in the first rounds
in a random bin, from round COORDINATES on in bin i - COORDINATES, so after twice as many rounds at most no bin is
empty; a bin keeps the least hash of the first round that reached it.  Two sketches agree in each coordinate with the
probability of the sets' similarity, and the share that agrees keeps to the bounds of as many independent draws.

Documents with equal sets form one class.  Classes that agree in all rows of a band share a bucket.  Every member of a bucket first
meets its leader, the member whose buckets are fullest (the text that copies stem from, most often); verified
links give components.  Where a bucket still holds members of several components, those outside of its
largest one meet a leader of their own, and then whoever is left meets all members in other components.  Pairs
within a component are never formed.  Candidates whose sketches agree in far too few coordinates go, all others are verified exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyloom.llm.components import components
from tallyloom.llm.jaccard import BLOOM, FIRST, _held, bloom, shingle_sets
from tallyloom.llm.scratch import stash
from tallyloom.llm.textscan import U, batches, mix

#: Bands and rows: at a similarity of 0.85 a pair shares no band with probability 4e-8, at 0.8 with 2e-5.
BANDS, ROWS = 36, 6
#: Coordinates of a sketch, a byte each; the first BANDS * ROWS make the bands, all tell how alike a pair is.
COORDINATES = 648
#: A candidate goes if its sketches agree in fewer coordinates than so many standard deviations below what the threshold makes one expect.
DEVIATIONS = 5
#: Members of a bucket that are compared with as many others by one task; pairs compared at once.
MEMBERS, COMPARED = 1024, 1 << 13
_RNG = np.random.Generator(np.random.PCG64(13))
ROUND = _RNG.integers(1, 2**63, 2 * 4096, dtype=np.uint64) * U(2) + U(1)
SUMS = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def sketches(sets: list[np.ndarray], coordinates: int = COORDINATES) -> np.ndarray:
    """A row of coordinates, a byte each, for each set; zeros for an empty one."""
    size = np.array([len(s) for s in sets], np.int64)
    best = np.full((len(sets), coordinates), np.iinfo(np.uint64).max, np.uint64)
    flat = best.reshape(-1)
    shingle, of = np.concatenate([np.zeros(0, np.uint64), *sets]), np.repeat(np.arange(len(sets)), size)
    missing = np.where(size > 0, coordinates, 0)  # empty bins
    for i in range(2 * coordinates):
        if not missing.any():
            break
        if i and (short := missing[of] > 0).sum() < len(of):  # only sets with empty bins go on
            shingle, of = shingle[short], of[short]
        h = mix(shingle * ROUND[i])
        place = (h >> U(32)) * U(coordinates) >> U(32) if i < coordinates else np.full(len(h), i - coordinates, np.uint64)
        at = of * coordinates + place.astype(np.int64)
        low = h & U(0xFFFFFFFF) | U(i << 32)  # a later round never replaces an earlier one
        np.minimum.at(flat, at, low)
        missing = np.count_nonzero(best == np.iinfo(np.uint64).max, axis=1) * (size > 0)
    return np.where(size[:, None] > 0, mix(best) & U(0xFF), U(0)).astype(np.uint8)


def _sketched(words: int, coordinates: int):
    """Rows (id, n, s1, s2, sketch): size, two sums and sketch of each document's set."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for lo, hi, t in batches(part.column("text")):
                sets = shingle_sets(t, words)
                sums = [np.array([mix(s * U(k)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64) for k in SUMS]
                sketch = pa.array([row.tobytes() for row in sketches(sets, coordinates)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("id")[lo:hi], pa.array([len(s) for s in sets], pa.int64()), *[pa.array(s, pa.int64()) for s in sums], sketch], names=["id", "n", "s1", "s2", "sketch"])

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    """The sketches of a batch as rows of coordinates."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _banded(bands: int, rows: int, shared=None):
    """Rows (bucket, band, id, n): the bucket of each band of each sketch; shared: a filter of the buckets that are asked for."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if part.num_rows:
                held = _matrix(part.column("sketch"))[:, : bands * rows].reshape(part.num_rows, bands, rows).astype(np.uint64)
                key = np.arange(bands, dtype=np.uint64) * U(0x9E3779B97F4A7C15) + U(1)
                for j in range(rows):
                    key = mix((key ^ held[:, :, j]) * U(0xD1342543DE82EF95))
                bucket = key.reshape(-1).view(np.int64)
                asked = np.flatnonzero(_held(shared.value, bucket)) if shared is not None else np.arange(len(bucket))
                of, band = np.divmod(asked, bands)
                yield pa.RecordBatch.from_arrays([pa.array(bucket[asked]), pa.array(band.astype(np.int32)), *[part.column(c).take(pa.array(of)) for c in ("id", "n")]], names=["bucket", "band", "id", "n"])

    return run


def _agreeing(least: int):
    """The pairs (a, b) whose sketches agree in so many coordinates."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if part.num_rows:
                equal = (_matrix(part.column("sketch_a")) == _matrix(part.column("sketch_b"))).sum(axis=1)
                yield part.select(["a", "b"]).filter(pa.array(equal >= least))

    return run


def _compared(bands: int, least: int, num: int, den: int):
    """The pairs (a, b) of two blocks, x and y, of each of some buckets that are to be verified."""

    def compare(x: int, y: int, band: int, own, ids, n, of, outside, kept, several, sketch) -> tuple[np.ndarray, np.ndarray]:
        left, right = np.flatnonzero(own == x), np.flatnonzero(own == y)
        step, out = max(1, COMPARED // max(1, len(right))), []
        for lo in range(0, len(left), step):
            i, j = (k.ravel() for k in np.meshgrid(left[lo : lo + step], right, indexing="ij"))
            able = (of[i] != of[j]) & (outside[i] | outside[j]) & (np.minimum(n[i], n[j]) * den >= np.maximum(n[i], n[j]) * num)
            if x == y:
                able &= ids[i] < ids[j]
            i, j = i[able], j[able]
            first = (((kept[i] == kept[j]) & (kept[i] != 0)).argmax(axis=1) == band) | several[i] | several[j]
            i, j = i[first], j[first]
            close = (sketch[i] == sketch[j]).sum(axis=1) >= least
            out += [np.minimum(ids[i[close]], ids[j[close]]), np.maximum(ids[i[close]], ids[j[close]])]
        none = [np.zeros(0, np.int64)]
        return np.concatenate(none + out[::2]), np.concatenate(none + out[1::2])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("bucket")
        bucket, x, y, band, own, ids, n, of = (table.column(c).to_numpy() for c in ("bucket", "x", "y", "band", "own", "id", "n", "component"))
        outside = table.column("outside").to_numpy(zero_copy_only=False).astype(bool)
        kept, several = np.zeros((len(ids), bands), np.int64), np.zeros(len(ids), bool)  # 0: no bucket; an id with several texts may have several of a band
        for i, buckets in enumerate(table.column("kept").to_pylist()):
            for b in buckets:
                several[i] |= kept[i, b["band"]] != 0
                kept[i, b["band"]] = b["bucket"]
        sketch = _matrix(table.column("sketch"))
        edge = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
        found = [compare(x[a], y[a], band[a], *(c[a:b] for c in (own, ids, n, of, outside, kept, several, sketch))) for a, b in zip(edge, edge[1:])]
        return pa.table({k: pa.array(np.concatenate([p[i] for p in found]), pa.int64()) for i, k in enumerate("ab")})

    return run


def _sets(words: int):
    """Rows (id, shingles); rows of a task that repeat an id with the same set are given once."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[tuple] = set()
        for part in parts:
            for lo, hi, t in batches(part.column("text")):
                ids, kept, keep = part.column("id")[lo:hi].to_pylist(), [], []
                for i, s in enumerate(shingle_sets(t, words)):
                    mark = ids[i], len(s), int(mix(s * U(SUMS[0])).sum(dtype=np.uint64))
                    if mark not in met:
                        met.add(mark)
                        keep.append(i)
                        kept.append(s.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in keep], pa.int64()), pa.array(kept, pa.list_(pa.int64()))], names=["id", "shingles"])

    return run


class NearDuplicates:
    """The steps over docs ``id, text`` (ids are not null)."""

    def __init__(self, docs: DataFrame, words: int, num: int, den: int, bands: int, rows: int, coordinates: int):
        self.docs, self.words, self.num, self.den, self.bands, self.rows, self.coordinates = docs, words, num, den, bands, rows, coordinates
        share = num / den
        self.least = max(1, int(self.coordinates * share - DEVIATIONS * (self.coordinates * share * (1 - share)) ** 0.5))

    def run(self) -> DataFrame:
        """``id, n_shingles, component`` of every row."""
        every = stash(self.docs.mapInArrow(_sketched(self.words, self.coordinates), "id long, n long, s1 long, s2 long, sketch binary"), "sketches")
        sign = ["n", "s1", "s2"]
        classes = stash(every.filter("n > 0").groupBy(*sign).agg(F.min("id").alias("id"), F.min("sketch").alias("sketch")), "classes")
        self.postings = self._shared(classes)
        self.popular = stash(self.postings.groupBy("id").agg(F.sum("members").alias("popular")), "popular")
        self.near = stash(classes.select("id", "sketch").join(self.popular, "id", "left_semi"), "near")
        links = self._verify(self._close(self._led(self.postings.select("bucket", "id", "n"))))
        label = components(links)
        for met in (lambda rows: self._close(self._led(rows)), self._met):
            if (rest := self._unsettled(label)).isEmpty():
                break
            known = label.filter("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b"))
            label = components(known.unionByName(self._verify(met(rest))))
        label = label.distinct()
        out = every.drop("sketch").join(classes.drop("sketch").withColumnRenamed("id", "rep").join(label.withColumnRenamed("id", "rep"), "rep", "left"), sign, "left")
        return out.select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "id").alias("component"))

    def _shared(self, classes: DataFrame) -> DataFrame:
        """``bucket, id, n, members`` of the buckets with several members.

        Most buckets have one; buckets alone are counted, and a Bloom filter of the others keeps single members out of the join.
        """
        sketches = classes.select("id", "n", "sketch")
        rows = "bucket long, band int, id long, n long"
        counted = sketches.mapInArrow(_banded(self.bands, self.rows), rows).groupBy("bucket").agg(F.count("*").alias("members"))
        full = stash(counted.filter("members > 1"), "buckets")
        bits = max(6, min(BLOOM.bit_length() - 1, (16 * full.count()).bit_length()))
        asked = classes.sparkSession.sparkContext.broadcast(bloom(full.withColumnRenamed("bucket", "token"), bits))
        return stash(sketches.mapInArrow(_banded(self.bands, self.rows, asked), rows).join(full, "bucket"), "shared")

    def _pairs(self, joined: DataFrame, a: str, b: str) -> DataFrame:
        """Distinct pairs (a, b) of sizes that can be alike."""
        sizes = F.least("n", "n_b") * self.den >= F.greatest("n", "n_b") * self.num
        return joined.filter((F.col(a) != F.col(b)) & sizes).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()

    def _led(self, rows: DataFrame) -> DataFrame:
        """Members of buckets with their bucket's leader; if rows say what is outside of the largest component, with the leader of these."""
        out = rows.filter("outside") if "outside" in rows.columns else rows.withColumn("component", F.col("id"))
        lead = out.join(self.popular, "id").groupBy("bucket").agg(F.max_by(F.struct("id", "n", "component"), F.struct("popular", -F.col("id"))).alias("lead"))
        lead = stash(lead.select("bucket", F.col("lead.id").alias("b"), F.col("lead.n").alias("n_b"), F.col("lead.component").alias("component_b")), "leaders")
        met = rows.join(lead, "bucket")
        return self._pairs(met.filter("component <> component_b") if "component" in rows.columns else met, "id", "b")

    def _unsettled(self, label: DataFrame) -> DataFrame:
        """``bucket, id, n, component, outside`` of buckets with several components; outside: not in the bucket's largest.

        Of buckets with the same members (bands of a passage that they share) only one is kept.
        """
        rows = self.postings.select("bucket", "band", "id", "n").join(label.select("id", "component").distinct(), "id", "left").withColumn("component", F.coalesce("component", "id"))
        sums = [F.sum(F.xxhash64(F.lit(k), "id").cast("decimal(38,0)")).alias(f"s{k}") for k in (1, 2)]
        groups = rows.groupBy("bucket", "component").agg(F.count("*").alias("k"), *sums).groupBy("bucket")
        groups = groups.agg(F.max_by("component", F.struct("k", "component")).alias("main"), F.count("*").alias("kinds"), F.sum("k").alias("k"), *[F.sum(f"s{k}").alias(f"s{k}") for k in (1, 2)])
        groups = stash(groups.filter("kinds > 1").groupBy("k", "s1", "s2").agg(F.min(F.struct("bucket", "main")).alias("at")).select("at.*", F.col("k").alias("members")), "mixed")
        rows = rows.join(groups, "bucket").withColumn("outside", F.expr("component <> main")).drop("main")
        kept = rows.groupBy("id").agg(F.collect_set(F.struct("band", "bucket")).alias("kept"))  # a bucket for each band, or few if an id has several texts
        return stash(rows.join(kept, "id"), "unsettled")

    def _met(self, rows: DataFrame) -> DataFrame:
        """Members outside of their bucket's largest component with those in other components whose sketches allow it, at the first bucket that both share.

        A bucket's members are dealt to blocks, and each two blocks are compared as a group, buckets of one block some together; only pairs
        that stand leave it.
        """
        together = 1 + rows.count() // (4 * MEMBERS)
        blocks = F.ceil(F.col("members") / MEMBERS).cast("int")
        own = F.pmod(F.xxhash64("id"), blocks).cast("int")
        rows = rows.join(self.near, "id").withColumns({"blocks": blocks, "own": own, "deal": F.when(blocks == 1, F.pmod(F.xxhash64("bucket"), F.lit(together))).otherwise(F.col("bucket"))})
        met = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
        rows = rows.select("deal", "bucket", "band", "id", "n", "component", "outside", "kept", "sketch", "own", met).withColumns({"x": F.least("own", "other"), "y": F.greatest("own", "other")})
        return rows.groupBy("deal", "x", "y").applyInArrow(_compared(self.bands, self.least, self.num, self.den), "a long, b long").distinct()

    def _close(self, pairs: DataFrame) -> DataFrame:
        """The pairs that the sketches allow."""
        pairs = stash(pairs, "candidates")
        side = lambda s: self.near.select(F.col("id").alias(s), F.col("sketch").alias(f"sketch_{s}"))
        return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_agreeing(self.least), "a long, b long").distinct()

    def _verify(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose whole sets are alike, as written links."""
        pairs = stash(pairs, "close")
        wanted = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
        sets = stash(self.docs.join(wanted, "id", "left_semi").mapInArrow(_sets(self.words), "id long, shingles array<bigint>"), "sets")
        side = lambda s: sets.select(F.col("id").alias(s), F.col("shingles").alias(f"set_{s}"))
        both = F.size(F.array_intersect("set_a", "set_b"))
        union = F.size("set_a") + F.size("set_b") - both
        joined = pairs.join(side("a"), "a").join(side("b"), "b")
        return stash(joined.filter(both.cast("long") * self.den >= union.cast("long") * self.num).select("a", "b").distinct(), "verified")


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = 5, num: int = 80, den: int = 100, bands: int = BANDS, rows: int = ROWS, coordinates: int = COORDINATES) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row: documents are linked if den * intersection >= num * union of their shingle sets.

    Links are confirmed on the whole sets, so no link is false; a pair at the threshold is missed if no band of
    its sketches agrees (see BANDS).  kept: the document is its component's least doc_id.  Documents without words (null or empty
    text) have no shingles, are linked with nothing and kept.  Rows that repeat a doc_id are one document, linked with each other where they
    have words; a null doc_id is one document, smaller than all others, whose component_id is null, and kept; doc_ids are
    numbers.  An empty table gives an empty result; other columns are not read.
    """
    if not 0 < bands * rows <= coordinates <= len(ROUND) // 2:
        raise ValueError("bands * rows must not exceed the coordinates, nor these 4096")
    plain = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(FIRST)).alias("id"), F.col(text).alias("text"))
    out = NearDuplicates(plain, words, num, den, bands, rows, coordinates).run()
    real = lambda c: F.when(F.col(c) != FIRST, F.col(c))
    return out.select(real("id").alias("doc_id"), "n_shingles", real("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents that share 0.85 of their three-word shingles."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=3, num=85, den=100)
