"""Text queries over whole documents and web pages."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions import markup, text
from foliospark.functions.quality import is_repetitive
from foliospark.plans import fixtures as X
from foliospark.plans.collapse_sql import collapse_ctes
from foliospark.plans.layout import CHANDRA_BLOCKS, LINES, _FORMULA, page_markdown_chandra, punct_sql, trim_sql
from foliospark.sources.readers import spread

# The documents hold few of the patterns the rules look for, so each text gets a tail of its own.
PUNCT_TAIL = ("concat(text, ' ', repeat('.', CAST(doc_id % 9 AS INT)), 'a', repeat('_', CAST(doc_id % 8 AS INT)), "
              "'b', repeat('-', CAST(doc_id % 7 AS INT)))")
RUN_TAIL = ("concat(text, ' ', repeat('x', CAST(doc_id % 15 AS INT)), ' ', repeat('abc', CAST(doc_id % 8 AS INT)), 'Z', chr(10), "
            "repeat('q_', CAST(doc_id % 31 AS INT)), repeat('!', CAST(doc_id % 13 AS INT)))")


def _docs(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return spread(X.table(spark, sf, "documents").select("doc_id", "text")).selectExpr("doc_id", *columns)


def repetition_flag(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf, "text").select("doc_id", is_repetitive(F.col("text")).alias("repetitive"))


REPETITION_SQL = """SELECT doc_id, len(text) >= 1000 AND contains(substr(text, greatest(len(text) - 2500, 0) + 1,
least(len(text) - 500, 2000)), right(text, 500)) AS repetitive FROM documents"""


def collapse_punct(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf, f"{PUNCT_TAIL} AS t").select("doc_id", text.collapse_punct(F.col("t")).alias("text"))


PUNCT_SQL = f"SELECT doc_id, {punct_sql(PUNCT_TAIL)} AS text FROM documents"


def collapse_runs(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf, f"{RUN_TAIL} AS t").select("doc_id", text.collapse_runs(F.col("t")).alias("text"))


RUNS_SQL = f"""WITH RECURSIVE src AS (SELECT doc_id AS id, {RUN_TAIL} AS txt FROM documents),
{collapse_ctes('src')} SELECT id AS doc_id, txt AS text FROM collapsed"""

_TAGS = "concat(text, repeat('<td r=', CAST(doc_id % 6 AS INT)), '>', repeat('<b', CAST(doc_id % 4 AS INT)))"


def collapse_tags(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf, f"{_TAGS} AS t").select("doc_id", text.collapse_tags(F.col("t")).alias("text"))


TAGS_SQL = """SELECT doc_id, concat(text, repeat('<td r=', CASE WHEN doc_id % 6 >= 3 THEN 1 ELSE CAST(doc_id % 6 AS INT) END),
'>', repeat('<b', CASE WHEN doc_id % 4 >= 3 THEN 1 ELSE CAST(doc_id % 4 AS INT) END)) AS text FROM documents"""


def line_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """Every third line is followed by a copy in another case and spacing, every fifth by junk."""
    doubled = F.transform(F.split("text", "\n"), lambda line, i: F.concat(
        line, F.when(i % 3 == 0, F.concat(F.lit("\n"), F.lower(F.replace(line, F.lit(" "), F.lit("  ")))))
        .otherwise(""), F.when(i % 5 == 0, F.lit("\n& -\n \n")).otherwise("")))
    return _docs(spark, sf, "text").select("doc_id", text.line_dedupe(
        F.array_join(doubled, "\n")).alias("text"))


def dedupe_lines_ctes(source: str, out: str) -> str:
    """CTEs from ``source(id, txt)`` to ``out(id, txt)`` without repeated lines."""
    return f"""
{out}_ln AS (SELECT id, unnest(string_split(txt, chr(10))) AS s,
  generate_subscripts(string_split(txt, chr(10)), 1) AS k FROM {source}),
{out}_nm AS (SELECT *, replace(lower(s), ' ', '') AS norm, {trim_sql('s')} = '' AS blank FROM {out}_ln),
{out}_lag AS (SELECT *, lag(norm) OVER (PARTITION BY id ORDER BY k) AS before FROM {out}_nm
  WHERE NOT blank AND norm <> '&-'),
{out}_keep AS (SELECT id, k, s FROM {out}_lag WHERE before IS DISTINCT FROM norm
  UNION ALL SELECT id, k, s FROM {out}_nm WHERE blank),
{out}_txt AS (SELECT id, string_agg(s, chr(10) ORDER BY k) AS txt FROM {out}_keep GROUP BY id),
{out} AS (SELECT i.id, coalesce(t.txt, '') AS txt FROM {source} i LEFT JOIN {out}_txt t USING (id))"""


LINE_DEDUPE_SQL = f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
  generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
src AS (SELECT doc_id AS id, string_agg(concat(line, CASE WHEN i % 3 = 0 THEN concat(chr(10),
  lower(replace(line, ' ', '  '))) END, CASE WHEN i % 5 = 0 THEN concat(chr(10), '& -', chr(10), ' ', chr(10)) END),
  chr(10) ORDER BY i) AS txt FROM l GROUP BY doc_id),
{dedupe_lines_ctes('src', 'd')} SELECT id AS doc_id, txt AS text FROM d"""

_MATH = ("concat('<math display=\"block\">', CASE WHEN doc_id % 2 = 0 THEN chr(10) ELSE ' ' END, left(text, 20), ' </math>', "
         "text, '<math class=\"i\"> x^', doc_id, chr(10), '</math>.')")


def math_to_latex(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf, f"{_MATH} AS t").select("doc_id", text.math_to_latex(F.col("t")).alias("text"))


MATH_SQL = f"""SELECT doc_id, regexp_replace(regexp_replace({_MATH},
'(?s)<math[^>]*display="block"[^>]*>\\s*(.*?)\\s*</math>', concat(chr(10), '$$', chr(10), '\\1', chr(10), '$$', chr(10)), 'g'),
'(?s)<math[^>]*>\\s*(.*?)\\s*</math>', ' $\\1$ ', 'g') AS text FROM documents"""

_CATEGORY = ("CASE doc_id % 6 WHEN 0 THEN 'Formula' WHEN 1 THEN 'Table' WHEN 2 THEN 'Picture' WHEN 3 THEN 'Image' "
             "ELSE 'Text' END")
_BLOCK_TEXT = f"CASE WHEN doc_id % 12 = 6 THEN concat('$$', text) ELSE concat('  ', {RUN_TAIL}, '.......') END"


def format_block(spark: SparkSession, sf: str) -> DataFrame:
    rows = _docs(spark, sf, f"{_CATEGORY} AS category", f"{_BLOCK_TEXT} AS t")
    return rows.select("doc_id", "category", text.format_block(F.col("category"), F.col("t")).alias("text"))


FORMAT_SQL = f"""WITH RECURSIVE b AS (SELECT doc_id, {_CATEGORY} AS category, {trim_sql(_BLOCK_TEXT)} AS t FROM documents),
src AS (SELECT doc_id AS id, {punct_sql('t')} AS txt FROM b WHERE category IN ('Image', 'Text')),
{collapse_ctes('src')}
SELECT doc_id, category, CASE category WHEN 'Formula' THEN {_FORMULA} WHEN 'Table' THEN t WHEN 'Picture' THEN t
ELSE txt END AS text FROM b LEFT JOIN collapsed ON id = doc_id"""


def data_uri(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf, "text").select(
        "doc_id", text.data_uri(F.encode("text", "UTF-8")).alias("uri"))


DATA_URI_SQL = """SELECT doc_id, concat('![image](data:image/png;base64,', base64(encode(text)), ')') AS uri FROM documents"""


def html_to_markdown(spark: SparkSession, sf: str) -> DataFrame:
    html = spread(X.table(spark, sf, "pages").select("page_id", "html"))
    return html.select("page_id", markup.chandra_markdown(F.col("html")).alias("markdown"))


# What becomes of the tags that the pages and the built responses hold, in order. Written down here for
# the checking SQL alone; marks that are never ended (all bold ones of the pages) are left out.
_PAGE_RULES = (
    (r"(?s)<!--.*?-->", ""), (r"(?i)<!doctype[^>]*>", ""), (r"(?is)<script>.*?</script>", ""),
    (r"(?is)<style>.*?</style>", ""), (r"(?i)</?(html|head|body)( [^>]*)?>", ""), ("<b>", ""), (r"\s*\n\s*", " "),
    (r'<a href="([^"]*)">\s*(.*?)\s*</a>', r"[\2](\1)"), (r"<h1>\s*(.*?)\s*</h1>", r"\n\n# \1\n\n"), ("<br>", r"\n"),
    (r"<li>\s*", r"\n- "), ("</li>", ""), (r"</?(p|div|ul)( [^>]*)?>", r"\n\n"), (r"[ \t]*\n[ \t]*", r"\n"),
    (r"\n{3,}", r"\n\n"))
_PAGE_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))


def html_sql(expr: str) -> str:
    for pattern, repl in _PAGE_RULES:
        made = " || ".join("chr(10)" if t == r"\n" else f"'{t}'" for t in re.split(r"(\\n)", repl) if t) or "''"
        expr = f"regexp_replace({expr}, '{pattern}', {made}, 'g')"
    for entity, plain in _PAGE_ENTITIES:
        expr = f"replace({expr}, '{entity}', '{plain}')"
    return trim_sql(expr)


HTML_SQL = f"""WITH src AS (SELECT page_id AS id, {html_sql('html')} AS txt FROM pages),
{dedupe_lines_ctes('src', 'd')} SELECT id AS page_id, {trim_sql(punct_sql('txt'))} AS markdown FROM d"""

# Fragments of every kind the contract names, one a line of a document, and what each has to become.
_WORD = "concat('w', regexp_extract({0}, '[A-Za-z]*', 0))"


def html_fragments(spark: SparkSession, sf: str) -> DataFrame:
    """HTML built from the lines of each document, and its Markdown."""
    def fragment(line, i):
        word = F.concat(F.lit("w"), F.regexp_extract(line, "[A-Za-z]*", 0))
        safe = F.replace(F.replace(line, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
        kinds = (
            ("<h2 class='q'> ", word, "\n</h2>"),
            ("<p>", safe, " <b> ", word, " </b></p>"),
            ("<ul>\n<li>", word, "<ol><li>x</li>\n<li>y</ol></li><li>z</li></ul>"),
            ("<table border=1><caption>C ", word, "</caption><tr><th colspan=2>", word, "</th><th rowspan='2'>k|l</th></tr>"
             "<tbody><tr><td>1<td>2</tr></tbody></table>"),
            ("<a href='u?a=1&amp;b=2'>", word, "</a>&eacute;<a href=http://v.w>v.w</a> <a>bare</a>"),
            ("<pre><code>  if ", word, ":\n    ", safe, "</code></pre>"),
            ('x <math display="block" title="a>b">', word, " &lt; b</math> y"),
            ("<!-- <p>no</p> --><img alt='", word, " > 1'><input type=radio checked> on<hr>"))
        pieces = [F.concat(*[F.lit(p) if isinstance(p, str) else p for p in kind]) for kind in kinds]
        chain = F.when(i % len(pieces) == 0, pieces[0])
        for k, piece in enumerate(pieces[1:], start=1):
            chain = chain.when(i % len(pieces) == k, piece)
        return F.concat(F.lit("<div>"), chain.otherwise(""), F.lit("</div>"))

    pages = X.pages(spark, sf).select("doc_id", F.array_join(F.transform(F.split("body", "\n"), fragment), "\n").alias("html"))
    return pages.select("doc_id", markup.html_to_markdown(F.col("html")).alias("markdown"))


FRAGMENTS_SQL = f"""WITH {LINES}, w AS (SELECT *, {_WORD.format('line')} AS w FROM lines),
md AS (SELECT doc_id, i, CASE i % 8
  WHEN 0 THEN '## ' || w
  WHEN 1 THEN {trim_sql("line || ' **' || w || '**'")}
  WHEN 2 THEN '- ' || w || chr(10) || '    1. x' || chr(10) || '    2. y' || chr(10) || '- z'
  WHEN 3 THEN 'C ' || w || chr(10) || chr(10) || '| ' || w || ' |  | k\\|l |' || chr(10) || '| --- | --- | --- |'
    || chr(10) || '| 1 | 2 |  |'
  WHEN 4 THEN '[' || w || '](u?a=1&b=2)é' || 'http://v.w bare'
  WHEN 5 THEN '```' || chr(10) || '  if ' || w || ':' || chr(10) || CASE WHEN {trim_sql('line')} = '' THEN '' ELSE '    ' || {trim_sql("'#' || line")}[2:] END || chr(10) || '```'
  WHEN 6 THEN 'x <math display="block" title="a>b">' || w || ' &lt; b</math> y'
  ELSE '![' || w || ' > 1]()[x]  on' || chr(10) || chr(10) || '* * *' END AS md FROM w)
SELECT doc_id, string_agg(md, chr(10) || chr(10) ORDER BY i) AS markdown FROM md GROUP BY doc_id"""

CHANDRA_MARKDOWN_SQL = f"""WITH {CHANDRA_BLOCKS},
shown AS (SELECT * FROM chandra WHERE category NOT IN ('Page-header', 'Page-footer')),
src AS (SELECT doc_id * 100000 + block_no AS id, {html_sql('text')} AS txt FROM shown WHERE category <> 'Image'),
{dedupe_lines_ctes('src', 'd')},
md AS (SELECT s.doc_id, s.block_no, CASE WHEN category = 'Image' THEN text ELSE {trim_sql(punct_sql('txt'))} END AS md
  FROM shown s LEFT JOIN d ON d.id = s.doc_id * 100000 + s.block_no),
joined AS (SELECT doc_id, string_agg(md, chr(10) || chr(10) ORDER BY block_no) AS md FROM md
  WHERE {trim_sql('md')} <> '' GROUP BY doc_id)
SELECT p.doc_id, coalesce({trim_sql('md')}, '') AS markdown FROM p LEFT JOIN joined USING (doc_id)"""

QUERIES = {
    "repetition_flag": (repetition_flag, REPETITION_SQL),
    "collapse_punct": (collapse_punct, PUNCT_SQL),
    "collapse_runs": (collapse_runs, RUNS_SQL),
    "collapse_tags": (collapse_tags, TAGS_SQL),
    "line_dedupe": (line_dedupe, LINE_DEDUPE_SQL),
    "math_to_latex": (math_to_latex, MATH_SQL),
    "format_block": (format_block, FORMAT_SQL),
    "data_uri": (data_uri, DATA_URI_SQL),
    "html_to_markdown": (html_to_markdown, HTML_SQL),
    "html_fragments": (html_fragments, FRAGMENTS_SQL),
    "page_markdown_chandra": (page_markdown_chandra, CHANDRA_MARKDOWN_SQL),
}
