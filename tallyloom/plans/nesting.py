"""Queries of nested code: braces that count, placeholders, and segments that keep blocks whole.

Texts with braces, literals and comments in every order come from the documents: some of their letters are read as marks.
"""

from pyspark.sql import functions as F

from tallyloom.operators import lexer
from tallyloom.plans.adapters import table
from tallyloom.plans.registry import query

MARKED = "regexp_replace(translate(coalesce(text, ''), 'qxzjkvw', '{}\"''/*\\'), '(^|\\n)[A-I][a-z]*', '{}fn', 'g')"
#: The same in both engines; Java and RE2 name the first group differently.
SPARK = MARKED.replace("{}fn", "$1fn").replace("'{}\"''/*\\'", r"""'{}"\'/*\\'""").replace("\\n", "\\\\n").replace(", 'g'", "")
DUCK = MARKED.replace("{}fn", r"\1fn")
HIDDEN = r"""(?s)//[^\n]*|/\*.*?\*/|"[^"\\]*(?:\\.[^"\\]*)*"|''[^''\\]*(?:\\.[^''\\]*)*''|(/\*).*|(").*|('').*"""
VISIBLE = f"regexp_replace({{}}, '{HIDDEN}', '\\1\\2\\3 ', 'g')"
COUNT = "length({0}) - length(replace({0}, '{1}', ''))"


@query("x16_nested_braces", f"WITH v AS (SELECT doc_id, {VISIBLE.format(DUCK)} AS code FROM documents) SELECT doc_id, {COUNT.format('code', '{')} AS opened, {COUNT.format('code', '}')} AS closed FROM v")
def x16_nested(spark, d):
    """Sums over lines, each from the state that it begins in."""
    rows = table(spark, d, "documents").selectExpr("doc_id AS file", f"posexplode(split({SPARK}, '\n', -1)) AS (p, text)").selectExpr("file", "p + 1 AS line", "text")
    return lexer.depths(rows).groupBy(F.col("file").alias("doc_id")).agg(F.sum("opened").alias("opened"), F.sum("closed").alias("closed"))


@query("x16_braces_of_texts", f"WITH v AS (SELECT doc_id, {VISIBLE.format(DUCK)} AS code FROM documents) SELECT doc_id, {COUNT.format('code', '{')} - ({COUNT.format('code', '}')}) AS balance FROM v")
def x16_texts(spark, d):
    found = table(spark, d, "documents").selectExpr("doc_id", f"{SPARK} AS text").select("doc_id", lexer.braces(F.col("text")).alias("b"))
    return found.select("doc_id", (F.col("b.opened") - F.col("b.closed")).cast("long").alias("balance"))


#: Every second line of a document begins with a mark of its place, every seventh of these is a placeholder.
PLACED = "CASE line % 14 WHEN 0 THEN '  // ... existing code here' WHEN 2 THEN '/* Unchanged */ x' WHEN 4 THEN '# ...' WHEN 6 THEN '#...' WHEN 8 THEN '<UNCHANGED>' WHEN 10 THEN 'x // ...' ELSE text END"


@query("x16_placeholders", f"WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS text, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line FROM documents), p AS (SELECT doc_id, lower(trim({PLACED})) AS t FROM l) SELECT doc_id, count(*) FILTER (WHERE " + " OR ".join(f"starts_with(t, '{x}')" for x in lexer.PLACEHOLDERS) + ") AS n FROM p GROUP BY doc_id")
def x16_placeholders(spark, d):
    rows = table(spark, d, "documents").selectExpr("doc_id", "posexplode(split(coalesce(text, ''), '\n', -1)) AS (p, text)").selectExpr("doc_id", "p + 1 AS line", "text")
    return rows.selectExpr("doc_id", f"{PLACED} AS text").groupBy("doc_id").agg(F.count_if(lexer.placeholder(F.col("text"))).alias("n"))


@query("x12_block_segments", f"""WITH t AS (SELECT doc_id, {DUCK} AS text FROM documents), l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM t),
p AS (SELECT doc_id, line, l, sum(length(l) + 1) OVER (PARTITION BY doc_id ORDER BY line) - 1 AS upto, text FROM l),
v AS (SELECT doc_id, line, l, {VISIBLE.format('substr(text, 1, upto::BIGINT)')} AS code FROM p),
a AS (SELECT doc_id, line, l, {COUNT.format('code', '{')} - ({COUNT.format('code', '}')}) AS after FROM v),
o AS (SELECT *, regexp_matches(l, '^\\s*(pub\\s+)?(fn|impl|trait|mod)\\s') AND coalesce(lag(after) OVER (PARTITION BY doc_id ORDER BY line), 0) = 0 AS opens FROM a),
g AS (SELECT *, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY line) AS part FROM o),
s AS (SELECT doc_id, part, min(line) AS lo, max(line) AS hi, min(line) FILTER (WHERE after = 0 AND NOT opens) AS closed FROM g GROUP BY 1, 2),
c AS (SELECT *, part > 0 AND closed - lo + 1 >= 5 AND closed < hi AS cut FROM s),
x AS (SELECT doc_id, lo AS a, CASE WHEN cut THEN closed ELSE hi END AS b FROM c UNION ALL SELECT doc_id, closed + 1, hi FROM c WHERE cut)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY a) AS segment, a, b FROM x""")
def x12_blocks(spark, d):
    rows = table(spark, d, "documents").selectExpr("doc_id AS file", f"posexplode(split({SPARK}, '\n', -1)) AS (p, text)").selectExpr("file", "p + 1 AS line", "text")
    return lexer.block_segments(rows, 5).select(F.col("file").alias("doc_id"), F.col("segment").cast("long").alias("segment"), F.col("start").alias("a"), F.col("end").alias("b"))
