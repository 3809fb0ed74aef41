"""Batches of very short texts: memory in proportion to the pieces, and still gapless sequences with little padding."""

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from tallyloom.llm import packing


def test_a_full_batch_of_one_id_pieces():
    sizes = np.ones(packing.PIECES_OF_BATCH, np.int64)
    tracemalloc.start()
    window = packing.pack_sizes(sizes, 2048)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.bincount(window).tolist() == [2048] * (len(sizes) // 2048)
    assert most < 200e6


def test_many_windows_and_short_pieces():
    sizes = np.tile([10, 3, 1, 7], 5000)
    tracemalloc.start()
    window = packing.differencing(sizes, 512)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    load = np.bincount(window, weights=sizes)
    assert len(load) == 512 and load.max() - load.min() <= 1 and most < 100e6


def test_a_million_empty_texts(spark):
    docs = spark.range(1_000_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "").alias("text"))
    packed = packing.pack(docs)
    got = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.count("*").alias("k"), F.max(F.col("offset") + F.col("length")).alias("end"))
    row = got.agg(F.sum("k"), F.max("n"), F.count("*"), F.count_if(F.col("n") != F.col("end"))).first()
    assert row[0] == 1_000_000 and row[1] <= 2048 and row[2] <= 1.01 * 1_000_000 / 2048 + 16 and row[3] == 0
