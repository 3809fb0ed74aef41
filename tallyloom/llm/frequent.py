"""The most frequent rows of a table of counts, at most so many, without sorting it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Bins of a count per doubling.
FINE = 32


def most_frequent(counts: DataFrame, count: str, most: int, *ties: str) -> DataFrame:
    """The ``most`` rows of counts with the highest counts; equal counts in ascending order of ties.

    Counting rows by bin of their count (32 bins per doubling) takes one aggregation whose result has 64 * 32 rows at
    most.  Bins that fit are taken whole; only the bin at the limit is sorted, and only as far as the limit.  What is kept is
    bounded whatever the table's size.  counts should be a written table, as it is read twice.
    """
    bin_ = F.floor(F.log2(count) * FINE)
    held, edge = 0, None
    for row in sorted(counts.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n")).collect(), reverse=True):
        if held + row.n > most:
            edge = row.bin
            break
        held += row.n
    if edge is None:
        return counts
    above = counts.filter(bin_ > edge)
    if held == most:
        return above
    return above.unionByName(counts.filter(bin_ == edge).orderBy(F.desc(count), *ties).limit(most - held))
