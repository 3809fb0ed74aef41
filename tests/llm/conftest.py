"""Documents with the cases that every operator must bear."""

import pytest
from conftest_llm import DIR

SCHEMA = "doc_id long, text string, source string, n_chars long, id long, token string, doc string, _key string, n_lines long, _gone int, row long"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and extra columns with clashing names."""
    long = " ".join(f"word{i % 977}" for i in range(60000))
    line = "this is a line of forty code points or more, yes"
    texts = [None, "", " \n\t ", "one", "One two\nthree", long, long + " end", line, line, f"x\n{line}\n{line.upper()}", f"{line}\n\n", f" {line}", "ünï çödé\x0b日本", "same", "same"]
    rows = [(i, t, ["a", "b", None][i % 3], len(t or ""), 1, "t", "d", "k", 2, 3, 4) for i, t in enumerate(texts)]
    rows += [rows[8], (None, "null id", None, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
