"""From raw documents to packed training sequences.

Stages, each written as Parquet and read again as the next one's documents: quality rules, line dedup, near
duplicates (one document of each component stays), mixing sources to target weights, packing.  All but
the last return the columns of documents.

Every stage bears nulls in any column, empty and very long texts, ties, repeated rows, empty tables and further columns of
any name; what it makes of them is stated at each.  An empty table gives an empty table.  doc_id is a number or null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm import jaccard, line_dedup, mixing, packing, quality
from tallyloom.llm.scratch import stash


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and the isolation forest, whose threshold comes from the labels table.

    Null and empty texts have no words, so they go; repeated rows and null ids are judged each; a score at the threshold is kept.
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 40 code points that five documents hold stay in one of them, that of the largest doc_id.

    All rows stay; a null text becomes empty; repeated rows of a doc_id are one document and lose the same lines.
    """
    return line_dedup.drop_frequent_lines(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at a Jaccard similarity of 0.8 of five-word shingles: that of the least doc_id.

    Texts without words stay; repeated rows of a doc_id stay or go together; a null id is smaller than all others.
    """
    return jaccard.keep_one(docs, words=5, num=80, den=100)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix of the sources takes them.

    A null source is one like others; repeated rows are taken each; texts without words go with whole epochs or before the cut.
    """
    return mixing.mix(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 ids.

    Every row is a document, a null or empty text its end id alone; a null doc_id stays null.
    """
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources", mix_sources),
    ("packing", pack_windows),
]

#: SQL expresses neither the forest nor the tokenizer; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
