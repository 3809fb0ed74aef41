"""Braces by a plain state machine over characters, and segments by a plain loop over lines."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import lexer


def machine(text):
    """(opened, closed, [state and depth at the begin of each line])."""
    state, i, opened, closed, lines = "code", 0, 0, 0, [(0, 0)]
    names = ["code", "block", '"', "'"]
    while i < len(text):
        c, two = text[i], text[i : i + 2]
        if state == "line":
            state = "code" if c == "\n" else "line"
        elif state == "block":
            if two == "*/":
                state, i = "code", i + 1
        elif state in "\"'":
            if c == "\\":
                i += 1
                c = text[i : i + 1]
            elif c == state:
                state = "code"
        elif two in ("//", "/*"):
            state, i = "line" if two == "//" else "block", i + 1
        elif c in "\"'":
            state = c
        else:
            opened, closed = opened + (c == "{"), closed + (c == "}")
        i += 1
        if c == "\n":
            lines.append((names.index(state), opened - closed))
    return opened, closed, lines


def texts(seed, n):
    rng = random.Random(seed)
    parts = ["{", "}", '"', "'", "\\", "/", "*", "//", "/*", "*/", "\n", "a", " ", "\nfn x() {", "}\n", '\\"', "ä"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 120))) for _ in range(n)] + ["", "\\", '"\\', '"' + "\\a" * 20000 + '"{', "/*" + "x" * 50000 + "*/{", "{" * 3000, '/"x"*{', "/*/{", "'\\''{"]


def as_lines(spark, found):
    return spark.createDataFrame([(str(i), n, x) for i, t in enumerate(found) for n, x in enumerate(t.split("\n"), 1)], "file string, line long, text string")


def test_whole_texts(spark):
    found = texts(1, 600)
    df = spark.createDataFrame(list(enumerate(found)), "i int, text string").select("i", lexer.braces(F.col("text")).alias("b"))
    assert {r.i: tuple(r.b) for r in df.collect()} == {i: machine(t)[:2] for i, t in enumerate(found)}


@pytest.mark.parametrize("block", [3, 512])
def test_lines_compose(spark, block, monkeypatch):
    monkeypatch.setattr(lexer, "BLOCK", block)
    found = texts(2, 300)
    rows = lexer.depths(as_lines(spark, found).repartition(7)).collect()
    want = {(str(i), n): s for i, t in enumerate(found) for n, s in enumerate(machine(t)[2], 1)}
    assert {(r.file, r.line): (r.state, r.depth) for r in rows} == want
    assert lexer.depths(as_lines(spark, ["x"]).limit(0)).count() == 0


def loop(text, most):
    """Segments of a text by its lines, their depth from the machine above."""
    lines, depth = text.split("\n"), [d for _, d in machine(text)[2]] + [machine(text)[0] - machine(text)[1]]
    out, start, inside = [], 1, False
    for i, x in enumerate(lines, 1):
        if re.match(r"\s*(pub\s+)?(fn|impl|trait|mod)\s", x) and depth[i - 1] == 0:
            if i > start:
                out.append((start, i - 1))
            start, inside = i, True
        elif inside and depth[i] == 0:
            if i - start + 1 >= most and i < len(lines):
                out.append((start, i))
                start = i + 1
            inside = False
    return out + ([(start, len(lines))] if start <= len(lines) else [])


def test_segments(spark):
    rng, found = random.Random(4), []
    for _ in range(60):
        out = []
        for _ in range(rng.randrange(1, 12)):
            body = [rng.choice(["  x = '}';", '  y("{");', "  // }", "  if a {", "  }", "", "  z();", "  /* {", "  */"]) for _ in range(rng.randrange(0, 9))]
            out += [rng.choice(["use a;", "pub fn f() {", "impl X {", "mod m {", "const A: u8 = 1;"]), *body, *["}"] * rng.randrange(0, 3)]
        found.append("\n".join(out))
    rows = lexer.block_segments(as_lines(spark, found), 6).collect()
    got = {str(i): [] for i in range(len(found))}
    for r in sorted(rows, key=lambda r: (int(r.file), r.segment)):
        got[r.file].append((r.start, r.end))
    assert got == {str(i): loop(t, 6) for i, t in enumerate(found)}
    assert sum(map(len, got.values())) > 100


def test_placeholders(spark, rows):
    df = spark.createDataFrame([(" // Existing code",), ("//...",), ("# ...x",), ("x // ...",), (None,), ("",), ("<UNCHANGED>",)], "t string")
    rows(df.select(lexer.placeholder(F.col("t"))), (True,), (False,), (True,), (False,), (False,), (False,), (True,))
