"""Snapshots are whole or not there; a run that is killed anywhere and taken up again ends as an unbroken one."""

import pytest
from pyspark.sql import functions as F

from tallyloom.sources.snapshots import REDACTED, Snapshots, redacted, run


class Killed(Exception):
    pass


class Dying(Snapshots):
    """Dies before its n-th write, or half-way through it."""

    def __init__(self, spark, path, at, half):
        super().__init__(spark, path)
        self.left, self.half = at, half

    def _due(self):
        self.left -= 1
        return self.left < 0

    def _write_table(self, df, path):
        due = self._due()
        if due and self.half:
            super()._write_table(df.limit(1), path)
        if due:
            raise Killed
        super()._write_table(df, path)

    def _write_manifest(self, text, path):
        due = self._due()
        if due and self.half:  # the file beside its place is there, half of it
            at, fs = self._at(f"{self.path}/manifests/.x.part")
            out = fs.create(at)
            out.write(bytearray(text[: len(text) // 2].encode()))
            out.close()
        if due:
            raise Killed
        super()._write_manifest(text, path)


def plan(spark):
    def count(k):
        def step(t):
            seen = t["input"].filter(F.col("chunk") == k).groupBy("key").agg(F.count("*").alias("n"))
            both = t["counts"].unionByName(seen).groupBy("key").agg(F.sum("n").alias("n"))
            return {**t, "counts": both, "log": t["log"].unionByName(seen.select(F.lit(k).alias("step"), "key"))}

        return step

    start = {"input": spark.range(60).select((F.col("id") % 3).alias("chunk"), (F.col("id") % 7).alias("key")), "counts": spark.createDataFrame([], "key long, n long"), "log": spark.createDataFrame([], "step int, key long")}
    return [(f"chunk {k}", count(k)) for k in range(3)], start


def rows(s):
    return {n: sorted(map(tuple, t.collect())) for n, t in s.tables.items()}


def test_killed_at_every_write(spark, tmp_path):
    steps, start = plan(spark)
    want = rows(run(Snapshots(spark, f"{tmp_path}/whole"), steps, start))
    assert want["counts"] == [(k, len([i for i in range(60) if i % 7 == k])) for k in range(7)]
    writes = 4 + 3 * 3  # three tables and a manifest, then two tables and a manifest a step
    for at in range(writes + 1):
        path = f"{tmp_path}/killed-{at}"
        dying = Dying(spark, path, at, half=at % 2 == 0)
        if at < writes:
            with pytest.raises(Killed):
                run(dying, steps, start)
        else:
            run(dying, steps, start)
        store = Snapshots(spark, path)
        assert store.steps() == list(range((at - 1) // 3 if at > 3 else 0))  # as many as have a manifest
        assert rows(run(store, steps, start)) == want


def test_taken_up_runs_do_only_what_is_left(spark, tmp_path):
    steps, start = plan(spark)
    done = []
    marked = [(n, lambda t, n=n, f=f: done.append(n) or f(t)) for n, f in steps]
    run(Snapshots(spark, f"{tmp_path}/a"), marked[:2], start)
    run(Snapshots(spark, f"{tmp_path}/a"), marked, start)
    run(Snapshots(spark, f"{tmp_path}/a"), marked, start)
    assert done == ["chunk 0", "chunk 1", "chunk 2"]
    with pytest.raises(ValueError, match="chunk 0"):
        run(Snapshots(spark, f"{tmp_path}/a"), [("other", steps[0][1])], start)
    with pytest.raises(ValueError, match="there already"):
        Snapshots(spark, f"{tmp_path}/a").publish(1, ["chunk 0"], start)


def test_vacuum_and_unchanged_tables(spark, tmp_path):
    steps, start = plan(spark)
    store = Snapshots(spark, f"{tmp_path}/v")
    with pytest.raises(Killed):
        run(Dying(spark, f"{tmp_path}/v", 5, True), steps, start)
    last = run(store, steps, start, {"api_token": "x"})
    assert last.paths["input"] == store.read(0).paths["input"]  # never written again
    want = rows(last)
    store.vacuum()
    assert store.steps() == [3] and rows(store.latest()) == want
    left = [p for p in (tmp_path / "v" / "data").glob("*/*")]
    assert len(left) == 3
    assert rows(run(store, steps, start)) == want
    with pytest.raises(ValueError):
        store.read(1)


def test_secrets_of_facts_stay_out(spark, tmp_path):
    facts = {"config": {"api_key": "k", "limit": 3, "more": [{"password": "p", "x": 1}]}, "seed": 5}
    store = Snapshots(spark, f"{tmp_path}/s")
    store.publish(0, [], {"t": spark.range(3)}, facts)
    assert store.latest().facts == {"config": {"api_key": REDACTED, "limit": 3, "more": [{"password": REDACTED, "x": 1}]}, "seed": 5} == redacted(facts)
    assert Snapshots(spark, f"{tmp_path}/none").latest() is None
