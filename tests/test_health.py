"""The trend of the health windows against SQL, to the last bit."""

import random

import duckdb
from pyspark.sql import functions as F

from tallyloom.operators import streaks


def trend(spark, counts):
    rows = spark.createDataFrame([("p", i, c) for i, c in enumerate(counts)], "project string, seq long, n int")
    no = F.lit(False)
    out = streaks.health(rows, ["project"], ["seq"], count="n", rollback=no, failed=no, accepted=F.lit(0), rejected=F.lit(0), from_memory=no, has_patch=no, label="project")
    return [r.trend for r in out.orderBy("seq").select("trend").collect()]


def test_trend_rounds_as_sql(spark):
    rng = random.Random(3)
    counts = [rng.randrange(60) for _ in range(400)]
    values = ", ".join(f"({i}, {c})" for i, c in enumerate(counts))
    sql = f"SELECT seq, regr_slope(c::DOUBLE, (seq + 1)::DOUBLE) OVER (ORDER BY seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) FROM (VALUES {values}) v(seq, c) ORDER BY seq"
    slopes = [s for _, s in duckdb.connect().sql(sql).fetchall()]
    assert trend(spark, counts)[1:] == [max(-1.0, min(1.0, -s / 5.0)) for s in slopes[1:]]


def test_trend_without_pairs(spark):
    assert trend(spark, [7, None, 9]) == [0.0, 0.0, -0.2]
    assert trend(spark, [None, None]) == [0.0, 0.0]
