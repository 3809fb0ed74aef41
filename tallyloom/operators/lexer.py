"""Lines of brace languages as effects of a finite-state lexer: which braces count, and how deep a line lies.

A line is lexed from each state that it can begin in (code, block comment, string, character), with regular expressions only.
That gives a transition map from the state before to the state after it, and the braces that count for each state.  Maps compose, so the
states of all lines come from three steps: the maps of a block of lines are composed, the blocks' maps are folded in order from the
file's begin, and then each block is folded from the state that it begins in.  A file of any length is spread over tasks by its blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tallyloom.functions.text import let

CODE, COMMENT, STRING, CHARACTER = range(4)
#: Lines of a block.
BLOCK = 512
# Possessive, so that Java's engine loops and does not recurse over long literals.
_IN_STRING, _IN_CHARACTER = (rf"[^{q}\\]*+(?:\\.[^{q}\\]*+)*+" for q in ('"', "'"))
#: What hides braces: whole comments and literals, or those that are open at the end, whose first mark is kept.
HIDDEN = rf"""(?s)//[^\n]*|/\*.*?\*/|"{_IN_STRING}"|'{_IN_CHARACTER}'|(/\*).*|(").*|(').*"""

# What stands for code that was left out.
PLACEHOLDERS = (
    "// existing code", "// ... rest of code", "// ... existing code", "// ...", "// unchanged", "// rest unchanged", "/* unchanged */", "/* ... */", "/* existing code */",
    "<rest of code>", "<unchanged>", "# existing code", "# unchanged", "# ...", "... existing code", "... rest of code",
)


def visible(text: Column) -> Column:
    """Code without comments and literals, a blank for each; an open one at the end leaves its first mark."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), F.lit(HIDDEN), F.lit("$1$2$3 "))


def _count(code: Column, brace: str) -> Column:
    return F.length(code) - F.length(F.replace(code, F.lit(brace), F.lit("")))


def braces(text: Column) -> Column:
    """``opened, closed``: curly braces of a whole text outside of strings, characters and comments."""
    code = visible(text)
    return F.struct(_count(code, "{").alias("opened"), _count(code, "}").alias("closed"))


def placeholder(line: Column) -> Column:
    """Whether a line only stands for code that was left out."""
    plain = F.lower(F.trim(F.coalesce(line, F.lit(""))))
    out = F.lit(False)
    for p in PLACEHOLDERS:
        out = out | F.startswith(plain, F.lit(p))
    return out


def _after(line: Column) -> Column:
    """State, opened and closed braces after a line that begins as code."""
    return let(visible(line), _state_and_braces)


def _state_and_braces(code: Column) -> Column:
    state = F.when(F.endswith(code, F.lit("/* ")), COMMENT).when(F.endswith(code, F.lit('" ')), STRING).when(F.endswith(code, F.lit("' ")), CHARACTER).otherwise(CODE)
    return F.struct(state.alias("state"), _count(code, "{").alias("opened"), _count(code, "}").alias("closed"))


def effect(line: Column) -> Column:
    """An array with what a line (without its end) does from each of the four states: ``state, opened, closed``."""

    def ended(state: int, mark: str, end: str) -> Column:
        stays = F.struct(F.lit(state).alias("state"), F.lit(0).alias("opened"), F.lit(0).alias("closed"))
        after = lambda left: F.when(F.length(left) < F.length(line), _after(left)).otherwise(stays)
        # most lines have no mark that ends the state
        return F.when(F.contains(line, F.lit(mark)), let(F.regexp_replace(line, F.lit(rf"(?s)\A{end}"), F.lit("")), after)).otherwise(stays)

    return F.array(_after(line), ended(COMMENT, "*/", r".*?\*/"), ended(STRING, '"', _IN_STRING + '"'), ended(CHARACTER, "'", _IN_CHARACTER + "'"))


def depths(lines: DataFrame) -> DataFrame:
    """``file, line, text, state, opened, closed, depth``: the state that a line begins in, its braces that count, and how many are open before it.

    lines: ``file, line`` (from 1, without gaps) ``, text``; a null text is empty.  depth is below 0 where more are closed than were opened.
    """
    rows = lines.select("file", F.col("line").cast("long").alias("line"), F.coalesce("text", F.lit("")).alias("text")).withColumn("_e", effect(F.col("text"))).withColumn("_block", F.floor((F.col("line") - 1) / BLOCK))
    states = F.transform("_e", lambda x: x["state"])
    maps = F.transform(F.array_sort(F.collect_list(F.struct("line", states.alias("m")))), lambda x: x["m"])
    blocks = rows.groupBy("file", "_block").agg(maps.alias("maps"))
    same = F.array(*[F.lit(s) for s in range(4)])
    composed = F.aggregate("maps", same, lambda m, n: F.transform(m, lambda s: F.get(n, s)))
    whole = blocks.select("file", "_block", composed.alias("map")).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("_block", "map"))).alias("maps"))
    begun = whole.select("file", F.explode(F.arrays_zip(F.transform("maps", lambda x: x["_block"]).alias("_block"), _before(F.transform("maps", lambda x: x["map"]), F.lit(CODE)).alias("begin"))).alias("b")).select("file", "b._block", "b.begin")
    inside = blocks.join(begun, ["file", "_block"]).select("file", "_block", F.posexplode(_before(F.col("maps"), F.col("begin"))).alias("_at", "state"))
    inside = inside.select("file", (F.col("_block") * BLOCK + F.col("_at") + 1).alias("line"), "state")
    found = rows.join(inside, ["file", "line"]).withColumn("_x", F.get("_e", F.col("state")))
    found = found.select("file", "line", "text", "state", F.col("_x.opened").alias("opened"), F.col("_x.closed").alias("closed"), "_block")
    net = F.col("opened") - F.col("closed")
    past = W.partitionBy("file").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    sums = found.groupBy("file", "_block").agg(F.sum(net).alias("_net")).withColumn("_base", F.coalesce(F.sum("_net").over(past), F.lit(0))).drop("_net")
    past = W.partitionBy("file", "_block").orderBy("line").rowsBetween(W.unboundedPreceding, -1)
    depth = F.col("_base") + F.coalesce(F.sum(net).over(past), F.lit(0))
    return found.join(sums, ["file", "_block"]).withColumn("depth", depth).drop("_block", "_base")


def _before(maps: Column, begin: Column) -> Column:
    """The state before each of the maps, in order."""
    start = F.struct(begin.cast("int").alias("now"), F.array().cast("array<int>").alias("all"))
    return F.aggregate(maps, start, lambda s, m: F.struct(F.get(m, s["now"]).alias("now"), F.concat(s["all"], F.array(s["now"])).alias("all")), lambda s: s["all"])


OPENER = r"^\s*(pub\s+)?(fn|impl|trait|mod)\s"


def block_segments(lines: DataFrame, most: int = 400) -> DataFrame:
    """``file, segment, start, end``: files cut at top-level blocks by their true nesting; no block is ever split.

    A segment begins at the file's begin and at each line at depth 0 that opens a function, implementation, trait or module.  It also
    ends at the first later line after which all braces are closed, if it has ``most`` lines by then.
    """
    w = W.partitionBy("file").orderBy("line")
    rows = depths(lines).select("file", "line", (F.col("text").rlike(OPENER) & (F.col("depth") == 0)).alias("opens"), (F.col("depth") + F.col("opened") - F.col("closed")).alias("after"))
    rows = rows.withColumn("part", F.sum(F.col("opens").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    parts = rows.groupBy("file", "part").agg(F.min("line").alias("lo"), F.max("line").alias("hi"), F.min(F.when((F.col("after") == 0) & ~F.col("opens"), F.col("line"))).alias("closed"))
    cut = (F.col("part") > 0) & (F.col("closed") - F.col("lo") + 1 >= most) & (F.col("closed") < F.col("hi"))
    pair = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
    two = F.array(pair(F.col("lo"), F.col("closed")), pair(F.col("closed") + 1, F.col("hi")))
    found = parts.select("file", F.explode(F.when(cut, two).otherwise(F.array(pair(F.col("lo"), F.col("hi"))))).alias("s")).select("file", "s.*")
    return found.select("file", F.row_number().over(W.partitionBy("file").orderBy("start")).alias("segment"), "start", "end")
