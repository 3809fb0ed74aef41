"""Packing token sequences into windows by Karmarkar-Karp multiway differencing.

Every document is cut into whole windows, which need no partner and are numbered where they are cut, and a rest, which is cut into
pieces of PIECE ids at most.  These pieces are dealt to batches by hash.  In a batch, each piece
begins as a partition of its own into k windows, all but one of them empty; the two partitions with
the largest spread between their fullest and emptiest window are merged again and again, fullest
with emptiest.  If a window of the last partition exceeds the capacity, k rises and the batch is packed anew.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyloom.llm.scratch import stash
from tallyloom.llm.tokens import crc, default_path, encode_batches, encoder

#: Ids a window holds, ids a piece of a rest has at most, windows and pieces of a batch (about).
CAPACITY, PIECE, WINDOWS, PIECES_OF_BATCH = 2048, 512, 512, 1 << 16
PIECES = "start long, length long, ids_crc32 long, doc_tokens long"


def differencing(sizes: np.ndarray, k: int) -> np.ndarray:
    """Window number, 0 to k - 1, of each of the sizes, with near-equal sums."""
    n = len(sizes)
    if n == 0:
        return np.zeros(0, np.int64)
    if k == 1:
        return np.zeros(n, np.int64)
    # a node is a piece (below n) or two nodes merged; -1: an empty window
    left, right = np.full(n * 2, -1, np.int64), np.full(n * 2, -1, np.int64)  # each merge leaves one node less to merge
    used = n
    heap = []
    for i, size in enumerate(sizes.tolist()):
        heap.append((-size, i, np.array([size]), np.array([i])))  # only the windows in use, fullest first; k - len(load) are empty
    heapq.heapify(heap)
    serial = n
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        over = len(a) + len(b) - k
        if over <= 0:
            load, node = np.concatenate((a, b)), np.concatenate((x, y))
        else:
            # a's emptiest windows in use, fullest first, take b's emptiest, emptiest first; the rest of b takes empty windows
            tail, own = slice(len(a) - over, len(a)), len(b) - over
            merged = np.arange(used, used + over)
            left[merged], right[merged] = x[tail], y[own:][::-1]
            used += over
            load, node = np.concatenate((a, b[:own])), np.concatenate((x, y[:own]))
            load[tail] += b[own:][::-1]
            node[tail] = merged
        order = np.argsort(-load, kind="stable")
        load, node = load[order], node[order]
        spread = int(load[0] - (load[-1] if len(load) == k else 0))
        heapq.heappush(heap, (-spread, serial, load, node))
        serial += 1
    out = np.zeros(n, np.int64)
    for window, root in enumerate(heap[0][3].tolist()):
        todo = [root]
        while todo:
            at = todo.pop()
            if at < n:
                out[at] = window
            else:
                todo += [int(left[at]), int(right[at])]
    return out


def pack_sizes(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Window of each of the sizes (none over capacity): the least number of windows at which differencing keeps to the capacity."""
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        window = differencing(sizes, k)
        if len(sizes) == 0 or np.bincount(window, weights=sizes).max() <= capacity:
            return window
        k += 1


def pack(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k.json", tokenizer_path: str | None = None, end_id: int = 1, capacity: int = CAPACITY, piece: int = PIECE, windows: int = WINDOWS, with_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` (and ``ids`` if asked for).

    Each row of docs is a document, so repeated rows are packed each; null text: empty, its end id only; a null
    doc_id stays null; an empty table gives an empty result; other columns are not read.  Only the pieces of rests are shuffled,
    texts and whole windows are not, so a text of any length adds one group member per ``piece`` ids of its rest at most.
    Batches hold about ``windows`` windows and PIECES_OF_BATCH pieces at most whatever the corpus's size and the texts' lengths.  Pieces that tie in size are told apart by doc_id, start and contents.
    """
    at = tokenizer_path or default_path(tokenizer)
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, {PIECES}" + ", ids array<int>" * with_ids

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        # the windows of this task have numbers of their own, beyond all batches
        number = 1 << 62 | TaskContext.get().partitionId() << 33
        for part, encoded in encode_batches(parts, encoder(at, True), "text"):
            row, start, length, crcs, total, ids, alone = [], [], [], [], [], [], []
            for i, x in enumerate(encoded):
                x = np.append(x.astype(np.uint32), np.uint32(end_id))
                whole = len(x) // capacity * capacity
                edges = [*range(0, whole, capacity), *range(whole, len(x), piece), len(x)]
                for lo, hi in zip(edges, edges[1:]):
                    row.append(i)
                    start.append(lo)
                    length.append(hi - lo)
                    crcs.append(crc(x[lo:hi]))
                    total.append(len(x))
                    alone.append(number if hi - lo == capacity else None)
                    number += hi - lo == capacity
                    if with_ids:
                        ids.append(x[lo:hi].astype(np.int32))
            columns = [part.column("doc_id").take(pa.array(row, pa.int64())), *[pa.array(c, pa.int64()) for c in (start, length, crcs, total)]]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(ids, pa.list_(pa.int32()))] * with_ids, pa.array(alone, pa.int64())], names=[*names, *["ids"] * with_ids, "sequence_id"])

    pieces = stash(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, f"{schema}, sequence_id long"), "pieces")
    rest = pieces.filter("sequence_id IS NULL").drop("sequence_id")
    rests, number = rest.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count("*")).first()
    batches = max(1, -(-rests // (capacity * windows)), -(-number // PIECES_OF_BATCH))
    key = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "length"), F.lit(batches))

    def fill(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("doc_id", "start", "ids_crc32", "doc_tokens")])
        size = table.column("length").to_numpy()
        batch = table.column("_batch").to_numpy()
        window = pack_sizes(size, capacity)
        order = np.argsort(window, kind="stable")
        total = np.cumsum(size[order]) - size[order]
        first = np.concatenate(([True], window[order][1:] != window[order][:-1]))
        offset = np.zeros(len(size), np.int64)
        offset[order] = total - np.maximum.accumulate(np.where(first, total, 0))
        return table.drop(["_batch"]).append_column("sequence_id", pa.array((batch.astype(np.int64) << 32) | window)).append_column("offset", pa.array(offset))

    packed = rest.withColumn("_batch", key).groupBy("_batch").applyInArrow(fill, f"{schema}, sequence_id long, offset long")
    return packed.unionByName(pieces.filter("sequence_id IS NOT NULL").withColumn("offset", F.lit(0).cast("long")))


def sequences(packed: DataFrame, pad_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """``sequence_id, n_tokens, ids`` of pieces packed with their ids: padded to capacity unless of a length that is a power of two."""
    joined = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"]))
    rows = packed.groupBy("sequence_id").agg(joined.alias("ids")).withColumn("n_tokens", F.size("ids").cast("long"))
    power = F.expr("n_tokens & (n_tokens - 1)") == 0
    return rows.select("sequence_id", "n_tokens", F.when(power, F.col("ids")).otherwise(F.concat("ids", F.array_repeat(F.lit(pad_id), capacity - F.col("n_tokens").cast("int")))).alias("ids"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 ids at most."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
