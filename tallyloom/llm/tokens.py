"""Token ids of whole texts from public tokenizer files, and canonical Huffman files of token ids.

Texts are cut into chunks that no token crosses, by array operations on their bytes; each chunk is
looked up by a hash of 64 bits, and only new chunks go to the tokenizers library.  A chunk found must also
agree in its polynomial over a prime; if one does not, its batch is encoded text by text.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tallyloom.llm.scratch import scratch_path, stash
from tallyloom.llm.textscan import JOIN, SPACE, U, Texts, batches, mix

#: Chunks that a worker remembers at most, and slots of its table.
ENTRIES, SLOTS = 1 << 21, 1 << 22
#: Ids that a worker remembers before it starts anew (places are 32-bit numbers).
FULL = 1 << 30
LETTER = np.isin(np.arange(256), list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"))
STOP = np.isin(np.arange(256), list(b".,"))


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _stops(t: Texts, space: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Full stops and commas at a word's end behind a letter (ASCII or Latin-1): both vocabularies split there, and more chunks are alike."""
    d = t.data
    letter = LETTER[d]
    letter[1:] |= (d[:-1] == 0xC3) & (d[1:] >= 0x80) & (d[1:] != 0x97) & (d[1:] != 0xB7)
    behind = np.concatenate(([False], letter[:-1])) & ~edge[:-1]
    last = np.concatenate((space[1:], [True])) | edge[1:]
    return STOP[d] & behind & last


def chunks(t: Texts, keeps_space: bool) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each chunk: words without white space; or, if that is kept, words with one space before them, and runs of other white space."""
    d = t.data
    if not len(d):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    space = SPACE[d]
    edge = np.zeros(len(d) + 1, bool)
    edge[t.off] = True
    stops = _stops(t, space, edge)
    before = np.concatenate(([False], space[:-1])) & ~edge[:-1]
    after = np.concatenate((space[1:], [True])) | edge[1:]
    if not keeps_space:
        start = np.flatnonzero(~space & (before | edge[:-1]) | stops)
        last = ~space & after
        last[:-1] |= stops[1:]
        return start, np.flatnonzero(last) + 1
    blank = np.concatenate(([False], d[:-1] == 32))
    start = np.flatnonzero(space & (~before | ~after) | ~space & (edge[:-1] | before & ~blank) | stops)
    return start, np.append(start[1:], len(d))


class Encoder:
    """Token ids of texts; the same as the tokenizers library gives for each whole text."""

    def __init__(self, path: str, keeps_space: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.kind = np.dtype("<u2" if self.vocabulary <= 1 << 16 else "<u4")
        self.keeps_space = keeps_space
        #: What is put between new chunks that are encoded together, and its id.
        self.mark = "\n" if keeps_space else "\x02"
        self.between = "\n" if keeps_space else " \x02 "
        ids = self._plain([self.mark])[0]
        self.mark_id = int(ids[0]) if len(ids) == 1 else -1
        self._clear()

    def _clear(self) -> None:
        self.slots = np.zeros(SLOTS, np.int32)  # entry; 0 is free
        self.key, self.guard = np.zeros(ENTRIES + 1, np.uint64), np.zeros(ENTRIES + 1, np.uint32)
        self.at, self.size = np.zeros(ENTRIES + 1, np.int32), np.zeros(ENTRIES + 1, np.int32)
        self.pool = np.zeros(1 << 20, self.kind)
        self.entries, self.used = 1, 0

    def _plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _new(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """An order of the chunks, their ids in it one after the other, and how many each has: many in one call, with marks between; those that hold a mark or white space alone by themselves."""
        apart = [i for i, x in enumerate(texts) if self.mark in x or not x.strip()] if self.mark_id >= 0 else list(range(len(texts)))
        held = set(apart)
        rest = [i for i in range(len(texts)) if i not in held]
        order, flat, sizes = [], [], []
        for lo in range(0, len(rest), 4096):
            part = rest[lo : lo + 4096]
            ids = np.array(self._plain([self.between.join([texts[i] for i in part])])[0], self.kind)
            at = np.flatnonzero(ids == self.mark_id)
            if len(at) != len(part) - 1:  # not expected; they are encoded one by one
                apart += part
                continue
            order.append(np.array(part))
            flat.append(np.delete(ids, at))
            sizes.append(np.diff(np.concatenate(([-1], at, [len(ids)]))) - 1)
        own = self._plain([texts[i] for i in apart])
        order.append(np.array(apart, np.int64))
        flat += [np.array(x, self.kind) for x in own]
        sizes.append(np.array([len(x) for x in own], np.int64))
        order, flat, sizes = np.concatenate(order), np.concatenate(flat) if flat else np.zeros(0, self.kind), np.concatenate(sizes)
        return order, flat, sizes

    def _find(self, key: np.ndarray) -> np.ndarray:
        """Entry of each key, or -1."""
        out = np.full(len(key), -1, np.int64)
        todo, slot = np.arange(len(key)), (key >> U(42)).astype(np.int64)
        while len(todo):
            held = self.slots[slot]
            hit = (held != 0) & (self.key[held] == key[todo])
            out[todo[hit]] = held[hit]
            on = ~hit & (held != 0)
            todo, slot = todo[on], (slot[on] + 1) & (SLOTS - 1)
        return out

    def _add(self, key: np.ndarray, guard: np.ndarray, texts: list[str]) -> np.ndarray:
        """Entries for new distinct keys."""
        n = len(key)
        order, flat, size = self._new(texts)
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
        new = np.empty(n, np.int64)
        new[order] = np.arange(self.entries, self.entries + n)
        self.pool[self.used : self.used + len(flat)] = flat
        self.at[new[order]], self.size[new[order]] = self.used + np.cumsum(size) - size, size
        self.key[new], self.guard[new] = key, guard
        self.entries, self.used = self.entries + n, self.used + len(flat)
        todo, slot = np.arange(n), (key >> U(42)).astype(np.int64)
        while len(todo):
            _, first = np.unique(slot, return_index=True)
            free = first[self.slots[slot[first]] == 0]
            self.slots[slot[free]] = new[todo[free]]
            on = np.ones(len(todo), bool)
            on[free] = False
            todo, slot = todo[on], (slot[on] + 1) & (SLOTS - 1)
        return new

    def encode(self, t: Texts) -> list[np.ndarray]:
        """The ids of each text, of type kind."""
        start, end = chunks(t, self.keeps_space)
        first, second = t.pairs(start, end)
        key, guard = mix(first + second * JOIN), second.astype(np.uint32)
        entry = self._find(key)
        missing = np.flatnonzero(entry < 0)
        if len(missing):
            new, first, back = np.unique(key[missing], return_index=True, return_inverse=True)
            if self.entries + len(new) > ENTRIES or self.used > FULL:
                self._clear()
                return self.encode(t) if len(new) < ENTRIES else self._whole(t)
            raw = t.data.tobytes()
            texts = [raw[a:b].decode() for a, b in zip(start[missing][first].tolist(), end[missing][first].tolist())]
            entry[missing] = self._add(new, guard[missing][first], texts)[back]
        if (self.guard[entry] != guard).any() or self.used > FULL:  # two chunks of the same key
            return self._whole(t)
        size = self.size[entry].astype(np.int64)
        total = np.concatenate(([0], np.cumsum(size)))
        flat = self.pool[np.repeat(self.at[entry] - total[:-1], size) + np.arange(total[-1])]
        edge = total[np.searchsorted(start, t.off)]
        out = [flat[a:b] for a, b in zip(edge, edge[1:])]
        if self.keeps_space:
            # white space beyond ASCII may join with what is around it: such texts are encoded whole
            d = t.data
            lead = np.flatnonzero((d == 0xC2) | (d >= 0xE1) & (d <= 0xE3))
            lead = lead[lead + 1 < len(d)]
            two = d[lead].astype(np.int64) << 8 | d[lead + 1]
            odd = lead[np.isin(two, (0xC285, 0xC2A0, 0xE19A, 0xE280, 0xE281, 0xE380))]
            for i in np.unique(np.searchsorted(t.off, odd, "right") - 1):
                out[i] = np.array(self._plain([t.data[t.off[i] : t.off[i + 1]].tobytes().decode()])[0], self.kind)
        return out

    def _whole(self, t: Texts) -> list[np.ndarray]:
        return [np.array(x, self.kind) for x in self._plain([t.data[a:b].tobytes().decode() for a, b in zip(t.off, t.off[1:])])]


@lru_cache(maxsize=4)
def encoder(path: str, keeps_space: bool) -> Encoder:
    """One encoder for all tasks of a worker."""
    return Encoder(path, keeps_space)


def encode_batches(parts: Iterator[pa.RecordBatch], coder: Encoder, text: str) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of the batches, with the ids of each row."""
    for part in parts:
        for lo, hi, t in batches(part.column(text)):
            yield part.slice(lo, hi - lo), coder.encode(t)


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


# --- canonical, length-limited Huffman codes ---

MAX_BITS = 16
BLOCK = 256


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Bits of each symbol's code: Huffman's lengths by package-merge, limit at most; 0 for symbols that do not occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError("more symbols than codes of that many bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.float64)
    # a package is told by how many of the lightest symbols and of the packages of the level below it takes
    levels, packages = [], np.zeros(0)
    for _ in range(limit):
        merged = np.concatenate((weight, packages))
        is_symbol = np.concatenate((np.ones(len(weight), bool), np.zeros(len(packages), bool)))
        by = np.argsort(merged, kind="stable")
        merged, is_symbol = merged[by], is_symbol[by]
        levels.append(np.cumsum(is_symbol))
        pairs = len(merged) // 2 * 2
        packages = merged[:pairs].reshape(-1, 2).sum(1)
    take, bits = 2 * (len(used) - 1), np.zeros(len(used), np.int64)
    for taken in reversed(levels):
        if take <= 0:
            break
        symbols = int(taken[take - 1])
        bits[:symbols] += 1
        take = 2 * (take - symbols)
    out[order] = bits
    return out


class Codes:
    """Canonical codes from lengths alone: shorter first, then by symbol."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        used = np.flatnonzero(lengths)
        self.order = used[np.lexsort((used, lengths[used]))]
        size = self.lengths[self.order]
        span = (1 << (MAX_BITS - size)).astype(np.int64)
        first = np.concatenate(([0], np.cumsum(span)))[:-1] if len(size) else np.zeros(0, np.int64)
        self.codes = np.zeros(len(lengths), np.uint64)
        self.codes[self.order] = (first >> (MAX_BITS - size)).astype(np.uint64)
        #: The symbol for every MAX_BITS bits.
        self.table = np.zeros(1 << MAX_BITS, np.uint32)
        filled = np.repeat(self.order, span)
        self.table[: len(filled)] = filled

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bit string, and the bit offset at which each BLOCK of ids begins."""
        bits = self.lengths[ids]
        start = np.concatenate(([0], np.cumsum(bits)))
        total = int(start[-1])
        words = np.zeros(total // 32 + 3, np.uint64)
        at = start[:-1]
        # a code of up to 16 bits lies in two words of 32 bits at most
        shifted = self.codes[ids] << (64 - (at & 31) - bits).astype(np.uint64)
        index = at >> 5
        np.bitwise_or.at(words, index, shifted >> np.uint64(32))
        np.bitwise_or.at(words, index + 1, shifted & np.uint64(0xFFFFFFFF))
        return words.astype(">u4").tobytes()[: (total + 7) // 8], at[::BLOCK].astype(np.uint64)

    def decode(self, payload: bytes, offsets: np.ndarray, n: int) -> np.ndarray:
        """The n ids.  All blocks are decoded side by side: each step looks up one id of every block."""
        raw = np.frombuffer(payload + b"\0" * 8, np.uint8).astype(np.uint32)
        out = np.zeros((BLOCK, len(offsets)), np.uint32)
        at = offsets.astype(np.int64)
        left = np.minimum(BLOCK, n - BLOCK * np.arange(len(offsets)))
        lengths = self.lengths
        for step in range(int(min(BLOCK, n)) if n else 0):
            live = len(at) if step < left[-1] else len(at) - 1
            p = at[:live]
            byte = p >> 3
            window = (raw[byte] << 16) | (raw[byte + 1] << 8) | raw[byte + 2]
            symbol = self.table[(window >> (8 - (p & 7)).astype(np.uint32)) & 0xFFFF]
            out[step, :live] = symbol
            p += lengths[symbol]
        return out.T.ravel()[:n]


# --- files ---

#: A shard's magic bytes; a shard holds SHARD ids or one document, whichever is more.
MAGIC, SHARD = b"TLH1", 1 << 18
SHARD_TYPE = "part int, shard int, before long, n_ids long, payload binary"


def pack_shard(doc_ids: np.ndarray, missing: np.ndarray, sizes: np.ndarray, ids: np.ndarray, codes: Codes) -> bytes:
    """One shard: header, code lengths, documents (id, null flag, size), checkpoints, bit string; all little-endian."""
    payload, offsets = codes.encode(ids)
    lengths = zlib.compress(codes.lengths.astype(np.uint8).tobytes(), 1)
    head = np.array([len(codes.lengths), len(lengths), len(doc_ids), len(ids), len(offsets), len(payload)], "<u8").tobytes()
    return b"".join([MAGIC, head, lengths, doc_ids.astype("<i8").tobytes(), missing.astype(np.uint8).tobytes(), sizes.astype("<u8").tobytes(), offsets.astype("<u8").tobytes(), payload])


def unpack_shard(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, null flags, sizes and ids of a shard."""
    if blob[:4] != MAGIC:
        raise ValueError("not a shard of token ids")
    _, n_lengths, docs, n, blocks, size = (int(x) for x in np.frombuffer(blob, "<u8", 6, 4))
    at = 52
    lengths = np.frombuffer(zlib.decompress(blob[at : at + n_lengths]), np.uint8)
    at += n_lengths
    doc_ids = np.frombuffer(blob, "<i8", docs, at)
    missing = np.frombuffer(blob, np.uint8, docs, at + 8 * docs).astype(bool)
    sizes = np.frombuffer(blob, "<u8", docs, at + 9 * docs).astype(np.int64)
    offsets = np.frombuffer(blob, "<u8", blocks, at + 17 * docs)
    at += 17 * docs + 8 * blocks
    return doc_ids, missing, sizes, Codes(lengths).decode(blob[at : at + size], offsets, n)


def write_token_files(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text", tokenizer: str = "word_bpe_49k.json", tokenizer_path: str | None = None, end_id: int = 2, vocabulary: int = 49408) -> None:
    """Encode all texts, count all ids, and write shards of Huffman-coded ids to path in ascending doc_id order.

    path gets a table of shards ``part, shard, before, n_ids, payload``; part and shard give the order, before is the
    number of ids in the part's earlier shards, payload is the shard's file.  Written through Spark's committer, so lost executors leave no half-written shard.
    Null text: empty, its end id only.  Null ids come first, equal ids in the order of their ids' bytes.
    An empty table gives a table without shards.
    """
    at = tokenizer_path or default_path(tokenizer)
    kind = np.dtype("<u2" if vocabulary <= 1 << 16 else "<u4")
    end = np.array([end_id], kind).tobytes()

    def encode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        names = ["doc_id", "ids", "used", "counts"]
        for part, ids in encode_batches(parts, encoder(at, False), "text"):
            n = len(ids)
            for x in ids:
                total += np.bincount(x, minlength=vocabulary) if len(x) > vocabulary // 8 else 0
            short = [x for x in ids if len(x) <= vocabulary // 8]
            if short:
                total += np.bincount(np.concatenate(short), minlength=vocabulary)
            total[end_id] += n
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([x.astype(kind).tobytes() + end for x in ids], pa.binary()), pa.nulls(n, pa.list_(pa.int32())), pa.nulls(n, pa.list_(pa.int64()))], names=names)
        used = np.flatnonzero(total)  # a task's counts come in a row of their own
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([used.astype(np.int32)], pa.list_(pa.int32())), pa.array([total[used]], pa.list_(pa.int64()))], names=names)

    written = stash(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(encode, "doc_id long, ids binary, used array<int>, counts array<bigint>"), "token-ids")
    encoded = written.filter("ids IS NOT NULL").select("doc_id", "ids")
    counts = np.zeros(vocabulary, np.int64)
    pairs = written.filter("used IS NOT NULL").select(F.explode(F.arrays_zip("used", "counts")).alias("x"))
    for row in pairs.groupBy(F.col("x.used").alias("id")).agg(F.sum("x.counts").alias("n")).collect():  # one row per id of the vocabulary
        counts[row.id] = row.n
    lengths = docs.sparkSession.sparkContext.broadcast(code_lengths(counts))

    def shards(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        codes, number, before, held = Codes(lengths.value), 0, 0, []

        def cut() -> pa.RecordBatch:
            ids = [np.frombuffer(b, kind) for _, b in held]
            doc_ids = np.array([d or 0 for d, _ in held], np.int64)
            whole = np.concatenate(ids).astype(np.uint32)
            blob = pack_shard(doc_ids, np.array([d is None for d, _ in held]), np.array([len(x) for x in ids], np.int64), whole, codes)
            return pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([number], pa.int32()), pa.array([before], pa.int64()), pa.array([len(whole)], pa.int64()), pa.array([blob], pa.binary())], names=["part", "shard", "before", "n_ids", "payload"])

        size = 0
        for part in parts:
            for row in zip(part.column("doc_id").to_pylist(), part.column("ids").to_pylist(), strict=True):
                held.append(row)
                size += len(row[1]) // kind.itemsize
                if size >= SHARD:
                    yield cut()
                    number, before, held, size = number + 1, before + size, [], 0
        if held:
            yield cut()

    encoded.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids").mapInArrow(shards, SHARD_TYPE).write.option("compression", "none").parquet(path)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """One row per document of the files: ``doc_id, start, n_tokens, ids_crc32`` and its ids; start: ids of all documents before it.

    Only the sums of the writer's tasks are added up and told to the readers (16 bytes a task); payloads stay
    where they are.
    """
    files = spark.read.schema(SHARD_TYPE).parquet(path)
    earlier = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", earlier.alias("base"))
    located = files.join(F.broadcast(parts), "part").select((F.col("base") + F.col("before")).alias("base"), "payload")
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, blob in zip(batch.column("base").to_pylist(), batch.column("payload"), strict=True):
                doc_ids, missing, sizes, ids = unpack_shard(blob.as_py())
                end = np.cumsum(sizes)
                raw = memoryview(ids.astype("<u4").tobytes())
                crcs = [zlib.crc32(raw[4 * (e - s) : 4 * e]) for s, e in zip(sizes.tolist(), end.tolist(), strict=True)]
                columns = [pa.array(doc_ids, pa.int64(), mask=missing), pa.array(base + end - sizes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], end)), pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return located.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the ids of all documents as Huffman files and return what reading them back gives."""
    path = scratch_path(spark, "token-files")
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_token_files(spark, path, with_ids=False)
