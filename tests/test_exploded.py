"""Rows of texts leave a task before all its texts are read."""

import pyarrow as pa

from tallyloom.operators import code


def test_rows_are_handed_on(spark, rows):
    seen = []

    def twice(text):
        seen.append(text)
        return [{"n": len(text)}, {"n": -1}]

    schema = pa.schema([("file", pa.string()), ("n", pa.int64())])
    texts = pa.RecordBatch.from_pydict({"file": [f"f{i}" for i in range(3 * code.FLUSH)], "text": [None, "ab", "c"] * code.FLUSH})
    out = code.exploded(iter([texts]), twice, schema, "file", "text")
    assert next(out).num_rows == code.FLUSH and len(seen) == code.FLUSH // 2
    rest = pa.Table.from_batches(list(out))
    assert rest.num_rows == 5 * code.FLUSH and rest.column("n")[-2].as_py() == 1
    got = code.explode_text(spark.createDataFrame([("a", "x"), ("b", None)], "file string, text string"), lambda t: [{"n": len(t)}], "n long", pa.schema([("n", pa.int64())]))
    rows(got, ("a", 1), ("b", 0))
    assert not list(code.exploded(iter([texts.slice(0, 3)]), lambda t: [], schema, "file", "text"))
