"""Patience diffs: every result is a valid edit script that keeps what it should."""

import random

from pyspark.sql import functions as F

from tallyloom.operators import patience


def scripts(spark, pairs):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "id long, before string, after string")
    out = {i: [] for i in range(len(pairs))}
    for r in patience.hunks(df.repartition(5)).orderBy("id", "i1", "j1").collect():
        out[r.id].append((r.tag, r.i1, r.i2, r.j1, r.j2))
    return out


def applied(before, after, script):
    """The lines that a script makes of before, taking new ones from after; also how many it keeps."""
    out, at, kept = [], 0, 0
    for tag, i1, i2, j1, j2 in script:
        assert at <= i1 <= i2 and len(out) + i1 - at == j1 <= j2
        assert tag == ("insert" if i1 == i2 else "delete" if j1 == j2 else "replace")
        out, kept = out + before[at:i1] + after[j1:j2], kept + i1 - at
        at = i2
    return out + before[at:], kept + len(before) - at


def test_scripts_are_valid_and_keep_unique_lines(spark):
    rng, pairs = random.Random(6), []
    for n in [0, 1, 2, 5, 40, 200] * 12:
        before = [f"line {rng.randrange(n * 2)}" if rng.random() < 0.8 else "}" for _ in range(n)]
        after = list(before)
        for _ in range(rng.randrange(0, 6)):
            at = rng.randrange(len(after) + 1)
            what = rng.randrange(4)
            if what == 0:
                after[at:at] = [f"new {rng.randrange(99)}"] * rng.randrange(1, 3)
            elif what == 1:
                del after[at : at + 2]
            elif what == 2 and after:
                after[min(at, len(after) - 1)] = "changed"
            else:
                after[at:] = after[at:][::-1] if rng.random() < 0.3 else after[at:]
        pairs.append(("".join(x + "\n" for x in before), "".join(x + "\n" for x in after)))
    pairs += [(None, "a\nb"), ("a", None), (None, None), ("same\n" * 500, "same\n" * 400), ("a\nb\nc", "c\na\nb")]
    for (b, a), script in zip(pairs, scripts(spark, pairs).values(), strict=True):
        before, after = (b or "").splitlines(), (a or "").splitlines()
        made, kept = applied(before, after, script)
        assert made == after
        if before == after:
            assert script == []
        # lines that are unique on both sides: a longest ascending part of them is a lower bound for what is kept in simple cases
        once = [x for x in before if before.count(x) == after.count(x) == 1]
        if once == [x for x in after if x in set(once)]:
            assert kept >= len(once)


def test_ascending_is_longest():
    rng = random.Random(7)
    for _ in range(300):
        x = rng.sample(range(50), rng.randrange(0, 12))
        got = [x[k] for k in patience.ascending(x)]
        assert got == sorted(got)
        best = [1] * len(x)
        for i in range(len(x)):
            best[i] = max([1] + [best[k] + 1 for k in range(i) if x[k] < x[i]])
        assert len(got) == max(best, default=0)


def test_long_texts(spark):
    """A hundred thousand lines with changes all over: linear, and nothing but the changes is given."""
    n = 100_000
    before = [f"line {i}" if i % 3 else "}" for i in range(n)]
    after = [x if i % 1000 != 500 else "changed" for i, x in enumerate(before)]
    script = scripts(spark, [("\n".join(before), "\n".join(after))])[0]
    assert [(t, i1, i2 - i1) for t, i1, i2, *_ in script] == [("replace", i, 1) for i in range(500, n, 1000)]


def test_near_a_line(spark, rows):
    df = spark.createDataFrame([(1, "a\nb\nc\nd\ne\nf\ng\nh\ni", "a\nB\nc\nd\ne\nf\ng\nh\nI")], "id int, before string, after string")
    places = spark.createDataFrame([(1, 2), (1, 12), (1, 30)], "id int, line int")
    found = patience.near_line(patience.hunks(df), places).select("line", F.concat_ws("-", "i1", "i2"))
    rows(found, (2, "1-2"), (12, "8-9"))
