"""Streams with state against their batch twins, with and without restarts in mid-stream."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import control
from tallyloom.streaming import stateful

HEALTH = "key string, seq long, stability double, success_rate double, entropy double, memory_rate double, rollback_rate double, trend double, overall double"
EVENT = "key string, seq long, ts timestamp, initial long, errors long, accepted long, rejected long"


def source(spark, df, path, by="seq", files=4):
    """A file stream of df, whose files follow each other in the order of ``by``."""
    n = df.count()
    cuts = sorted(r[0] for r in df.select(by).collect())
    for i in range(files):
        lo, hi = cuts[i * n // files], cuts[(i + 1) * n // files - 1]
        df.filter(F.col(by).between(lo, hi)).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)  # files are read by their times
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def stopped_and_restarted(spark, rows, tmp_path, batches=2):
    """The rows of a stream that stops after some batches and of one that takes up from its checkpoint."""
    for n in (batches, None):
        stateful.drain(spark, rows, f"{tmp_path}/out", f"{tmp_path}/checkpoint", n)
    return spark.read.parquet(f"{tmp_path}/out").drop("batch")


def plain(df):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=str)


def test_governor_is_its_batch_twin(spark, tmp_path):
    rng = random.Random(1)
    rows = [(f"k{i % 5}", i, *[rng.random() for _ in range(7)]) for i in range(200)]
    health = spark.createDataFrame(rows, HEALTH)
    stream = source(spark, health, f"{tmp_path}/in")
    got = stopped_and_restarted(spark, stateful.govern(stream), tmp_path)
    want = control.govern(health, "key", "seq")
    assert plain(got) == plain(want.select(got.columns))
    assert len({r.max_patch_size for r in got.collect()}) > 50


def _events(spark, rng, keys=12, cycles=30):
    rows, seq = [], 0
    for c in range(cycles):
        for k in range(keys):
            errors = max(0, 40 - c * (k % 4) + rng.choice((0, 0, 1, -1)) * (k % 3)) if k else 40
            rows.append((f"k{k}", seq, 1_700_000_000 + c * 10 + k * 0.01, 40, errors, rng.choice((0, 0, 1)) if k % 5 else 0, rng.choice((0, 3))))
            seq += 1
    rows += [("silent", seq, 1_700_000_000.0, 10, 9, 1, 0), ("gone", seq + 1, 1_700_000_000.5, 10, 0, 1, 0)]
    df = spark.createDataFrame(rows, "key string, seq long, s double, initial long, errors long, accepted long, rejected long")
    return df.withColumn("ts", F.timestamp_micros((F.col("s") * 1_000_000).cast("long"))).select(*[f.split()[0] for f in EVENT.split(", ")])


def test_controller_is_its_batch_twin(spark, tmp_path):
    events = _events(spark, random.Random(2))
    stream = source(spark, events, f"{tmp_path}/in", "ts")
    got = stopped_and_restarted(spark, stateful.control_cycles(stream, budget=200.0), tmp_path)
    want = {tuple(r) for r in control.cycles(events, budget=200.0).select("key", "seq", "cycle", "cap", "stop_reason").collect()}
    silent = [r for r in got.collect() if r.key == "silent"]
    assert [(r.cycle, r.stop_reason) for r in silent] == [(1, None), (1, "runtime_budget")]  # ended by its timer
    rest = lambda rows: {r for r in rows if r[0] != "silent" and r[4] != "runtime_budget"}
    have = {(r.key, r.seq, r.cycle, r.cap, r.stop_reason) for r in got.collect()}
    assert rest(have) == rest(want)
    # a run that reaches its budget ends once, by a late cycle or by its timer, after the same cycles
    ended = lambda rows: {(r[0], r[2]) for r in rows if r[4] == "runtime_budget" and r[0] != "silent"}
    assert ended(have) == ended(want)
    assert len({r[4] for r in have}) >= 4 and any(r[3] > 4 for r in have)


@pytest.mark.parametrize("rows,reason", [
    ([(5, 1, 0), (0, 1, 0)], "completed"), ([(13, 0, 0)], "global_invariant"), ([(9, 1, 0), (9, 0, 0), (9, 0, 0)], "plateau"),
    ([(10, 1, 0), (9, 0, 0), (9, 0, 0), (9, 0, 0)], "max_cycles"), ([(11, 1, 0), (12, 1, 0)], "error_growth"), ([(8, 0, 2), (9, 0, 0), (8, 0, 0)], None), ([(9, 0, 2), (8, 0, 2)], "reject_spike"),
    ([(10, 1, 0), (10, 1, 0), (10, 1, 0), (10, 0, 0)], "max_cycles"), ([(10, 0, 0), (10, 0, 0)], "plateau"), ([(9, 0, 0), (9, 0, 0), (9, 0, 0)], "plateau"), ([(11, 0, 0), (11, 0, 0)], "no_progress"),
])
def test_cycles_end_by_the_first_rule(rows, reason):
    state = control.Cycles(10, 0.0)
    for i, (errors, accepted, rejected) in enumerate(rows):
        assert state.reason is None
        state.record(i, errors, accepted, rejected)
    assert state.reason == reason


def test_the_cap_grows_while_there_is_progress():
    state = control.Cycles(100, 0.0, most=9)
    for i in range(40):
        state.record(i, 90 - i, 1, 0)
        if state.reason:
            break
    assert (state.cycle, state.cap, state.reason) == (9, 9, "max_cycles")
    late = control.Cycles(100, 0.0)
    for i in range(4):
        late.record(48.0 * (i + 1), 90 - i, 1, 0)
    assert (late.cycle, late.reason) == (4, "max_cycles")  # at 0.8 of the budget the cap stands


def test_cache_entries_end(spark, tmp_path):
    rng = random.Random(3)
    rows, seq = [], 0
    for s in range(0, 600, 3):
        rows.append((f"k{rng.randrange(9)}", seq, 1_700_000_000.0 + s))
        seq += 1
    rows.append(("last", seq, 1_700_001_000.0))
    df = spark.createDataFrame(rows, "key string, seq long, s double").withColumn("ts", F.timestamp_micros((F.col("s") * 1_000_000).cast("long"))).drop("s")
    stream = source(spark, df, f"{tmp_path}/in", files=5)
    got = stopped_and_restarted(spark, stateful.cached(stream, 100.0), tmp_path).collect()
    saved, want = {}, []
    for key, n, s in rows:
        hit = key in saved and s < saved[key] + 100
        saved[key] = saved[key] if hit else s
        want.append((key, n, "hit" if hit else "miss"))
    assert sorted((r.key, r.seq, r.outcome) for r in got if r.outcome != "expired") == sorted(want)
    assert {r.key for r in got if r.outcome == "expired"} == {f"k{i}" for i in range(9)}  # all but the last request's


def test_state_is_dropped_by_the_store(spark, tmp_path):
    """Processing time: what was first seen longer ago than the time to live is not known any more."""
    df = spark.createDataFrame([("a", "x", 1), ("a", "x", 2), ("b", "x", 3)], "key string, what string, seq long")

    def again(name, ttl):
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in-{name}")
        stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in-{name}")
        stateful.drain(spark, stateful.seen_recently(stream, ttl), f"{tmp_path}/out-{name}", f"{tmp_path}/c-{name}", no_data=False)
        rows = spark.read.parquet(f"{tmp_path}/out-{name}").collect()
        return [r.known for r in sorted(rows, key=lambda r: (r.key, r.seq)) if r.batch == max(x.batch for x in rows)]

    assert again("long", 600_000) == [False, True, False]
    assert again("long", 600_000) == [True, True, True]
    assert again("short", 2_000) == [False, True, False]
    time.sleep(3)
    assert again("short", 2_000) == [False, True, False]
