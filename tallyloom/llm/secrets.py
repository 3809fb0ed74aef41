"""Secret scans: patterns over whole texts, and guess costs of values that stand where credentials do.

A value after words like "password" or "api key" is segmented into dictionary words, dates, repeats,
keyboard walks and brute-force spans at the least total cost by dynamic programming, as in
low-budget password-strength estimation; values that would take many guesses are reported.  The
dictionary is the corpus's own most frequent words, counted over all documents but not inside such values.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyloom.llm.frequent import most_frequent
from tallyloom.llm.scratch import stash

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
CREDENTIAL = r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|(?:api|access|private|secret|auth)[_-]?(?:key|token)|auth(?:orization)?|credentials?|bearer)["']?(?:\x20*(?:[:=]|=>|:=)\x20*|\x20+is\x20+)["']?"""
CONTEXT = re.compile(r"(?<![A-Za-z0-9])" + CREDENTIAL + r"""([^\s"'<>,;]{6,})""", re.I | re.A)
#: What the dictionary is not learned from: every value in credential context.
VALUE = "(?i)" + CREDENTIAL + r"""[^\s"'<>,;]+"""
#: Words of the learned dictionary, at most, and documents that a word is in, at least; parameters of the model, like the least log10 of guesses.
WORDS, IN_DOCS, LEAST = 20000, 8, 10.0
LONGEST_WORD, SEGMENT = 24, math.log10(2)
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LEET = str.maketrans("@4301!5$7", "aaeoiisst")
PERIODS, WALK, WALKED = 8, math.log10(47), math.log10(2.5)
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
DATE = re.compile(r"(?:(?:19|20)\d\d[-/.]?(?:0?[1-9]|1[0-2])[-/.]?(?:0?[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])[-/.]?(?:0?[1-9]|1[0-2])[-/.]?(?:(?:19|20)?\d\d)|(?:19|20)\d\d)")


def _neighbours() -> dict[str, frozenset]:
    """Keys beside each key, each row shifted by half a key to the right."""
    at = {c: (y, x + y / 2) for y, row in enumerate(ROWS) for x, c in enumerate(row)}
    return {c: frozenset(d for d, (v, u) in at.items() if d != c and abs(v - y) <= 1 and abs(u - x) <= (1 if v == y else 0.5)) for c, (y, x) in at.items()}


BESIDE = _neighbours()


def _char_cost(c: str) -> float:
    return math.log10(10 if c.isdigit() else 26 if "a" <= c <= "z" or "A" <= c <= "Z" else 33 if c.isascii() else 200)


class Words:
    """A dictionary of ranked words, with an automaton that finds all of them in one pass over a value."""

    def __init__(self, rank: dict[str, int]):
        self.rank, self.automaton = rank, None
        if rank:
            self.automaton = ahocorasick.Automaton()
            for w, r in rank.items():
                self.automaton.add_word(w, (len(w), r))
            self.automaton.make_automaton()

    def within(self, value: str) -> Iterator[tuple[int, int, float]]:
        """(end, start, log10 of guesses) of every dictionary word in value, plainly or by look-alike characters, by end."""
        if self.automaton is None:
            return
        low = value.translate(LOWER)
        plain = low.translate(LEET)
        found = [(e + 1, e + 1 - n, r, 0.0) for e, (n, r) in self.automaton.iter(low)]
        if plain != low:
            found += [(e + 1, e + 1 - n, r, 0.5) for e, (n, r) in self.automaton.iter(plain) if plain[e + 1 - n : e + 1] != low[e + 1 - n : e + 1]]
            found.sort(key=lambda x: x[0])
        for end, start, r, extra in found:
            part = value[start:end]
            case = 0.0 if part == low[start:end] else 0.3 if part.isupper() or part[:1].isupper() and part[1:] == low[start + 1 : end] else 1.0
            yield end, start, math.log10(r + 1) + case + extra


def repeats(value: str) -> list[np.ndarray]:
    """For each period from 1, how many whole times what begins at a place stands there in a row, at most."""
    code = np.array([ord(c) for c in value], np.int64)
    n, out = len(value), []
    for period in range(1, min(PERIODS, n - 1) + 1):
        stop = np.append(np.where(code[:-period] != code[period:], np.arange(n - period), n - period), [n - period] * period)
        run = np.minimum.accumulate(stop[::-1])[::-1] - np.arange(n)  # characters that equal the one a period later
        out.append((np.maximum(run, 0) + period) // period)
    return out


def guess_cost(value: str, words: Words) -> tuple[float, list[tuple[int, int, str]]]:
    """log10 of the guesses for value, and its cheapest segments as (start, end, "brute" or "match").

    Segments cost the log10 of their guesses and SEGMENT each.  A repeat takes as many whole times as there are (three at
    least of one character, else two); a walk of three keys or more may end at any of them.  Brute force and walks
    extend by characters, and words come from one pass of an automaton, so the time is linear in the length for any value.
    """
    n = len(value)
    inf = float("inf")
    best, brute = [inf] * (n + 1), [inf] * (n + 1)
    back: list = [None] * (n + 1)
    opened = [0] * (n + 1)
    best[0] = 0.0
    low, found = value.translate(LOWER), words.within(value)
    word = next(found, None)
    cost = [_char_cost(c) for c in value]
    total = [0.0]
    for c in cost:
        total.append(total[-1] + c)
    times = repeats(value)
    one = two = three = (inf, 0)  # cheapest walks of so many keys (three: or more) that end here: cost, start
    for i in range(n + 1):
        if i and brute[i] < best[i]:
            best[i], back[i] = brute[i], (opened[i], "brute")
        while word is not None and word[0] == i:
            if (c := best[word[1]] + SEGMENT + word[2]) < best[i]:
                best[i], back[i] = c, (word[1], "match")
            word = next(found, None)
        if i:
            if i > 1 and low[i - 1] in BESIDE.get(low[i - 2], ()):
                longer = min(two, three)
                two, three = (one[0] + WALKED, one[1]), (longer[0] + WALKED, longer[1])
            else:
                two = three = (inf, 0)
            one = (best[i - 1] + SEGMENT + WALK, i - 1)
            if three[0] < best[i]:
                best[i], back[i] = three[0], (three[1], "match")
        if i == n:
            break
        new = best[i] + SEGMENT
        if new <= brute[i]:
            brute[i + 1], opened[i + 1] = new + cost[i], i
        else:
            brute[i + 1], opened[i + 1] = brute[i] + cost[i], opened[i]
        if "0" <= value[i] <= "9" and (m := DATE.match(value, i)):
            c = new + math.log10(150 if len(m[0]) == 4 else 365 * 150) + (0.6 if any(x in "-/." for x in m[0]) else 0)
            if c < best[m.end()]:
                best[m.end()], back[m.end()] = c, (i, "match")
        for period, count in enumerate(times, 1):
            if (k := int(count[i])) >= (3 if period == 1 else 2):
                c, j = new + total[i + period] - total[i] + math.log10(k), i + k * period
                if c < best[j]:
                    best[j], back[j] = c, (i, "match")
    parts, at = [], n
    while at:
        start, kind = back[at]
        parts.append((start, at, kind))
        at = start
    return best[n], parts[::-1]


def spans(text: str, words: Words, least: float = LEAST) -> list[tuple[int, int, str, float]]:
    """All (start, end, kind, log10 of guesses) in text by start, then kind; the cost is that of the value."""
    out = [(m.start(), m.end(), "assign", guess_cost(m[1], words)[0]) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    out += [(m.start(), m.end(), "access", guess_cost(m[0], words)[0]) for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex", guess_cost(m[0], words)[0]) for m in HEX.finditer(text)]
    for m in CONTEXT.finditer(text):
        value = m[1].rstrip(".!?)")
        if len(value) >= 6 and (cost := guess_cost(value, words)[0]) >= least:
            out.append((m.start(1), m.start(1) + len(value), "guess", cost))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def common_words(docs: DataFrame, text: str = "text", words: int = WORDS, in_docs: int = IN_DOCS) -> dict[str, int]:
    """Rank, from 1, of the lower-case ASCII words of three to LONGEST_WORD letters that are in most documents; ``words`` at most.

    All documents are counted; values in credential context are cut out first, so no secret teaches the
    dictionary itself, however often it is copied; words in fewer than in_docs documents are left out at any size.
    """
    outside = F.regexp_replace(F.col(text), F.lit(VALUE), F.lit(" "))
    each = F.array_distinct(F.regexp_extract_all(F.lower(outside), F.lit("(?<![a-z])([a-z]{3,%d})(?![a-z])" % LONGEST_WORD), 1))
    counted = stash(docs.select(F.explode(each).alias("w")).groupBy("w").agg(F.count("*").alias("n")).filter(F.col("n") >= in_docs), "words")
    top = sorted((-r.n, r.w) for r in most_frequent(counted, "n", words, "w").collect())
    return {w: i for i, (_, w) in enumerate(top, 1)}


def scan(docs: DataFrame, rank: dict[str, int] | None = None, *, doc_id: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """One row per row of docs: ``doc_id, secrets array<struct<start, end, kind, guesses_log10>>`` by start and kind.

    Whole texts and whole values of any length are scanned, in linear time; spans of different kinds may overlap and begin
    at the same place, then they stand in the order of KINDS; a null or empty text has no secrets; null ids and repeated rows give rows
    of their own; an empty table gives an empty result; other columns are not read.  rank: the dictionary,
    by default that of docs.
    """
    shared = docs.sparkSession.sparkContext.broadcast(common_words(docs, text) if rank is None else rank)
    kind = docs.schema[doc_id].dataType.simpleString()
    inner = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("guesses_log10", pa.float64())]))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(shared.value)
        for part in parts:
            found = [[dict(zip(("start", "end", "kind", "guesses_log10"), s, strict=True)) for s in spans(x, words, least)] if x else [] for x in part.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(doc_id), pa.array(found, inner)], names=[doc_id, "secrets"])

    return docs.select(doc_id, text).mapInArrow(run, f"`{doc_id}` {kind}, secrets array<struct<start: long, end: long, kind: string, guesses_log10: double>>")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts and a digest of the base kinds, and all spans."""
    rows = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long")
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("secrets", lambda s: s["kind"] != "guess")
    cost = F.array_max(F.transform("secrets", lambda s: s["guesses_log10"]))
    return rows.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined("secrets").alias("spans"), cost.alias("max_guesses_log10"))
