"""Layout queries: response parsing, blocks, page and document Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions import bbox as B
from foliospark.functions import blocks as K
from foliospark.operators import assemble
from foliospark.operators.dedupe import block_dedupe as dedupe_rows
from foliospark.operators.dialects import (block_rows, chandra, deepseek, dots,
                                           page_markdown, parse_responses)
from foliospark.plans import fixtures as X
from foliospark.plans.collapse_sql import collapse_ctes
from foliospark.schemas import HEADER_FOOTER, PICTURES
from foliospark.sources.readers import spread

# ---------------------------------------------------------------------------
# Checking SQL shared by several queries
# ---------------------------------------------------------------------------
PAGES = X.cte("p", "documents", X.PAGE_COLS)
LINES = f"""{PAGES},
lines AS (
  SELECT doc_id, task_id, page_index, width, height, body,
         unnest(string_split(body, chr(10))) AS line,
         generate_subscripts(string_split(body, chr(10)), 1) - 1 AS i,
         len(string_split(body, chr(10))) AS n
  FROM p)"""
# Unicode white space at either end, and blank text.
TRIM = r"regexp_replace(regexp_replace({0}, '^[\s\p{{Z}}\x0B\x85]+', ''), '[\s\p{{Z}}\x0B\x85]+$', '')"


def trim_sql(expr: str) -> str:
    return TRIM.format(expr)


BOX = ("CAST(i % 20 * 7 AS FLOAT) AS x1, CAST(i % 20 * 11 AS FLOAT) AS y1, "
       "CAST(i % 20 * 7 + 100 AS FLOAT) AS x2, CAST(i % 20 * 11 + 30 AS FLOAT) AS y2")

DOTS_CATEGORY = ("CASE label WHEN 'PageHeader' THEN 'Page-header' WHEN 'Page-header' THEN 'Text' "
                 "ELSE label END")
# A recovered text that ends in an escaped quote loses the quote and keeps the backslash; the last
# line of a cut-off response also loses trailing blanks.
DOTS_BLOCKS = f"""{LINES},
named AS (SELECT *, {X.label_sql('dots')} AS label,
          CASE WHEN doc_id % 4 = 3 AND i = n - 1 THEN {trim_sql("'#' || line")}[2:] ELSE line END AS cut
          FROM lines),
raw AS (SELECT doc_id, task_id, page_index, i, {DOTS_CATEGORY} AS category,
        CASE WHEN i % 11 = 10 THEN NULL ELSE concat_ws(',', i % 20 * 7, i % 20 * 11,
             i % 20 * 7 + 100, i % 20 * 11 + 30) END AS bbox,
        CASE WHEN {trim_sql('cut')} = '' THEN ''
             WHEN right(cut, 1) = '"' THEN left(cut, len(cut) - 1) || chr(92)
             ELSE cut END AS text FROM named),
capped AS (SELECT * FROM (SELECT *, row_number() OVER (
             PARTITION BY doc_id, category, text ORDER BY i) AS k FROM raw) WHERE k <= 10),
boxed AS (SELECT * FROM (SELECT *, row_number() OVER (
             PARTITION BY doc_id, bbox ORDER BY i) AS b FROM capped) WHERE bbox IS NULL OR b = 1),
dots AS (SELECT doc_id, task_id, page_index, category, text, bbox,
         CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS block_no FROM boxed)"""

DEEPSEEK_BLOCKS = f"""{LINES},
tags AS (SELECT *, {X.label_sql('deepseekocr')} AS label FROM lines
         WHERE doc_id % 29 <> 0 AND i % 13 <> 12),
shaped AS (SELECT doc_id, task_id, page_index, i,
    CASE WHEN label IN ('title', 'sub_title') THEN 'Title' WHEN label IN ('table', 'grid') THEN 'Table'
         WHEN label = 'image' THEN 'Image' ELSE 'Text' END AS category,
    {trim_sql('line')} AS plain,
    CAST(CAST(i % 20 * 7 AS FLOAT) / CAST(999 AS FLOAT) AS FLOAT) * CAST(width AS FLOAT) AS x1,
    CAST(CAST(i % 20 * 11 - 3 AS FLOAT) / CAST(999 AS FLOAT) AS FLOAT) * CAST(height AS FLOAT) AS y1,
    CAST(CAST(i % 20 * 7 + 109 AS FLOAT) / CAST(999 AS FLOAT) AS FLOAT) * CAST(width AS FLOAT) AS x2,
    CAST(CAST(i % 20 * 11 + 30 AS FLOAT) / CAST(999 AS FLOAT) AS FLOAT) * CAST(height AS FLOAT) AS y2,
    width, height FROM tags),
whole AS (SELECT doc_id, task_id, page_index, -1 AS i, 'Text' AS category,
          {trim_sql('body')} AS plain, CAST(NULL AS FLOAT) AS x1, CAST(NULL AS FLOAT) AS y1,
          CAST(NULL AS FLOAT) AS x2, CAST(NULL AS FLOAT) AS y2, width, height FROM p
          WHERE doc_id % 29 = 0 AND {trim_sql('body')} <> ''),
both_kinds AS (SELECT * FROM shaped UNION ALL SELECT * FROM whole),
deepseekocr AS (SELECT doc_id, task_id, page_index, category,
    CASE WHEN category = 'Title' AND left(plain, 1) <> '#' THEN '### ' || plain ELSE plain END AS text,
    CAST(CASE WHEN x1 IS NOT NULL THEN greatest(CAST(0 AS FLOAT), x1) END AS DOUBLE) AS x1,
    CAST(CASE WHEN y1 IS NOT NULL THEN greatest(CAST(0 AS FLOAT), y1) END AS DOUBLE) AS y1,
    CAST(CASE WHEN x2 IS NOT NULL THEN least(CAST(width AS FLOAT), x2) END AS DOUBLE) AS x2,
    CAST(CASE WHEN y2 IS NOT NULL THEN least(CAST(height AS FLOAT), y2) END AS DOUBLE) AS y2,
    CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS block_no
    FROM both_kinds)"""

_SX = "CAST(CAST(width AS FLOAT) / CAST(1024 AS FLOAT) AS FLOAT)"
_SY = "CAST(CAST(height AS FLOAT) / CAST(1024 AS FLOAT) AS FLOAT)"
CHANDRA_BLOCKS = f"""{LINES},
divs AS (SELECT doc_id, task_id, page_index, i, width, height, {X.label_sql('chandra')} AS label, line,
         i % 9 = 8 AS bad, {BOX} FROM lines),
inner_text AS (SELECT doc_id, any_value(task_id) AS task_id, any_value(page_index) AS page_index,
    any_value(width) AS width, any_value(height) AS height, string_agg(concat(
      '<div data-bbox="', CASE WHEN bad THEN 'bad' ELSE concat('[', CAST(x1 AS INT), ', ',
      CAST(y1 AS INT), ', ', CAST(x2 AS INT), ', ', CAST(y2 AS INT), ']') END,
      '" data-label="', label, '"><p>', line, '</p></div>'), chr(10) ORDER BY i) AS t
    FROM divs WHERE doc_id % 5 = 0 GROUP BY doc_id),
parts AS (
  SELECT doc_id, task_id, page_index, i, width, height, label, concat('<p>', line, '</p>') AS text,
         CASE WHEN NOT bad THEN x1 END AS x1, CASE WHEN NOT bad THEN y1 END AS y1,
         CASE WHEN NOT bad THEN x2 END AS x2, CASE WHEN NOT bad THEN y2 END AS y2 FROM divs
  UNION ALL
  SELECT doc_id, task_id, page_index, -1, width, height, 'Complex-Block', t,
         CAST(0 AS FLOAT), CAST(0 AS FLOAT), CAST(1024 AS FLOAT), CAST(512 AS FLOAT) FROM inner_text),
chandra AS (SELECT doc_id, task_id, page_index,
    CASE label WHEN 'Section-Header' THEN 'Section-header' WHEN 'Page-Header' THEN 'Page-header'
         WHEN 'Complex-Block' THEN 'Complex-block' WHEN 'Unknown' THEN 'Text' ELSE label END AS category,
    text, CAST(greatest(CAST(0 AS FLOAT), x1 * {_SX}) AS DOUBLE) * (x1 = x1)::INT AS x1,
    CAST(greatest(CAST(0 AS FLOAT), y1 * {_SY}) AS DOUBLE) * (y1 = y1)::INT AS y1,
    CAST(least(CAST(width AS FLOAT), x2 * {_SX}) AS DOUBLE) * (x2 = x2)::INT AS x2,
    CAST(least(CAST(height AS FLOAT), y2 * {_SY}) AS DOUBLE) * (y2 = y2)::INT AS y2,
    CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS block_no FROM parts)"""

LAYOUT = X.cte("b", "lineitem", X.BLOCK_COLS)


def _box_text(df: DataFrame) -> DataFrame:
    """Whole-number boxes as text."""
    numbers = F.transform("bbox", lambda v: v.cast("int").cast("string"))
    return df.withColumn("bbox", F.when(F.col("bbox").isNotNull(), F.array_join(numbers, ",")))


def box_numbers(df: DataFrame) -> DataFrame:
    corners = [F.get("bbox", F.lit(k)).cast("double").alias(n)
               for k, n in enumerate(("x1", "y1", "x2", "y2"))]
    return df.select("*", *corners).drop("bbox")


# ---------------------------------------------------------------------------
# Parsing
# ---------------------------------------------------------------------------
def parse_dots(spark: SparkSession, sf: str) -> DataFrame:
    parsed = parse_responses(X.responses(spark, sf, "dots"), "dots")
    return _box_text(block_rows(parsed, "doc_id"))


PARSE_DOTS_SQL = f"WITH {DOTS_BLOCKS} SELECT doc_id, block_no, bbox, category, text FROM dots"


def parse_deepseek(spark: SparkSession, sf: str) -> DataFrame:
    parsed = parse_responses(X.responses(spark, sf, "deepseekocr"), "deepseekocr")
    return box_numbers(block_rows(parsed, "doc_id"))


PARSE_DEEPSEEK_SQL = (f"WITH {DEEPSEEK_BLOCKS} "
                      "SELECT doc_id, block_no, category, text, x1, y1, x2, y2 FROM deepseekocr")


def parse_chandra(spark: SparkSession, sf: str) -> DataFrame:
    parsed = parse_responses(X.responses(spark, sf, "chandra"), "chandra")
    return box_numbers(block_rows(parsed, "doc_id"))


PARSE_CHANDRA_SQL = (f"WITH {CHANDRA_BLOCKS} "
                     "SELECT doc_id, block_no, category, text, x1, y1, x2, y2 FROM chandra")


def parse_json_strict(spark: SparkSession, sf: str) -> DataFrame:
    answers = X.pages(spark, sf).withColumn("r", dots.strict_json(X.raw_json()))
    boxes = F.transform("r.blocks", lambda b: F.array_join(F.transform(b["bbox"], lambda v: (v * 2).cast("int").cast("string")), ","))
    return answers.select("doc_id", F.col("r.ok").alias("ok"), F.size("r.blocks").alias("blocks"),
                          F.array_join(F.transform("r.blocks", lambda b: b["text"]), "\n").alias("text"),
                          F.array_join(F.array_distinct(F.transform(
                              "r.blocks", lambda b: b["category"])), ",").alias("categories"),
                          F.array_join(boxes, " ").alias("boxes"))


PARSE_JSON_STRICT_SQL = f"""WITH {LINES}, x AS (SELECT doc_id, string_agg(concat_ws(',', i % 20 * 14, i % 20 * 22,
  i % 20 * 14 + 200, i % 20 * 22 + 61), ' ' ORDER BY i) AS boxes FROM lines GROUP BY doc_id)
SELECT doc_id, doc_id % 5 IN (0, 2) AS ok,
CAST(CASE WHEN doc_id % 5 IN (0, 2) THEN len(string_split(body, chr(10))) ELSE 0 END AS INT) AS blocks,
CASE WHEN doc_id % 5 IN (0, 2) THEN body ELSE '' END AS text,
CASE WHEN doc_id % 5 IN (0, 2) THEN 'Section-header' ELSE '' END AS categories,
CASE WHEN doc_id % 5 IN (0, 2) THEN boxes ELSE '' END AS boxes FROM p JOIN x USING (doc_id)"""


def blocks_json(spark: SparkSession, sf: str) -> DataFrame:
    """Cleaned blocks written back as JSON, read again with the strict parser."""
    parsed = parse_responses(X.responses(spark, sf, "dots"), "dots")
    text = parsed.select("doc_id", F.to_json("blocks", {"ignoreNullFields": "false"}).alias("json"))
    again = text.withColumn("r", dots.strict_json(F.col("json"))).select(
        "doc_id", F.col("r.blocks").alias("blocks"))
    return _box_text(block_rows(again, "doc_id"))


# ---------------------------------------------------------------------------
# Blocks
# ---------------------------------------------------------------------------
def category_map(spark: SparkSession, sf: str) -> DataFrame:
    """The categories of every label that the responses of each dialect hold, a row per line."""
    lines = X.pages(spark, sf).select("doc_id", F.posexplode(F.split("body", "\n")).alias("i", "line"))
    label = {d: X.label_of(d, F.col("i")) for d in ("dots", "chandra", "deepseekocr")}
    return lines.select("doc_id", "i", dots.category_of(label["dots"]).alias("dots"),
                        dots.category_of(label["dots"], "intended").alias("dots_intended"),
                        chandra.category_of(label["chandra"]).alias("chandra"),
                        deepseek.category_of(label["deepseekocr"]).alias("deepseek"))


CATEGORY_MAP_SQL = f"""WITH {LINES}, l AS (SELECT doc_id, CAST(i AS INT) AS i, {X.label_sql('dots')} AS d,
  {X.label_sql('chandra')} AS c, {X.label_sql('deepseekocr')} AS s FROM lines)
SELECT doc_id, i, CASE d WHEN 'PageHeader' THEN 'Page-header' WHEN 'Page-header' THEN 'Text' ELSE d END AS dots,
CASE d WHEN 'PageHeader' THEN 'Page-header' ELSE d END AS dots_intended,
CASE c WHEN 'Section-Header' THEN 'Section-header' WHEN 'Page-Header' THEN 'Page-header' WHEN 'Unknown' THEN 'Text' ELSE c END AS chandra,
CASE WHEN s IN ('title', 'sub_title') THEN 'Title' WHEN s IN ('table', 'grid') THEN 'Table' WHEN s = 'image' THEN 'Image'
     ELSE 'Text' END AS deepseek FROM l"""


def picture_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Picture blocks per page, those that can be cropped, and whether there is any."""
    picture = F.col("category").isin(*PICTURES)
    croppable = picture & F.coalesce(F.size("bbox") == 4, F.lit(False))
    return X.block_table(spark, sf).groupBy("task_id", "page_index").agg(
        F.bool_or(picture).alias("has_pictures"), F.count_if(picture).alias("pictures"),
        F.count_if(croppable).alias("croppable"))


PICTURE_BLOCKS_SQL = f"""WITH {LAYOUT} SELECT task_id, page_index,
bool_or(category IN ('Picture', 'Figure')) AS has_pictures,
count(*) FILTER (WHERE category IN ('Picture', 'Figure')) AS pictures,
count(*) FILTER (WHERE category IN ('Picture', 'Figure') AND NOT no_box) AS croppable
FROM b GROUP BY ALL"""


def header_footer_filter(spark: SparkSession, sf: str) -> DataFrame:
    kept = X.block_table(spark, sf).filter(~F.col("category").isin(*HEADER_FOOTER))
    return kept.select("task_id", "page_index", "block_no", "category")


HEADER_FOOTER_SQL = f"""WITH {LAYOUT} SELECT task_id, page_index, block_no, category FROM b
WHERE category NOT IN ('Page-header', 'Page-footer')"""


def block_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    kept = dedupe_rows(spread(X.block_table(spark, sf)).select(
        "task_id", "page_index", "block_no", "category", "text", "bbox"))
    return _box_text(kept)


BLOCK_DEDUPE_SQL = f"""WITH {LAYOUT},
capped AS (SELECT * FROM (SELECT *, CASE WHEN no_box THEN NULL ELSE concat_ws(',', bx1, by1, bx2, by2)
  END AS bbox, row_number() OVER (PARTITION BY task_id, page_index, category, text ORDER BY block_no) AS k
  FROM b) WHERE k <= 10)
SELECT task_id, page_index, block_no, category, text, bbox FROM (SELECT *, row_number() OVER (
  PARTITION BY task_id, page_index, bbox ORDER BY block_no) AS r FROM capped)
WHERE bbox IS NULL OR r = 1"""


def bbox_corners(spark: SparkSession, sf: str) -> DataFrame:
    return X.block_table(spark, sf).select("task_id", "page_index", "block_no", *[
        B.corner(F.col("bbox"), k).alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))])


BBOX_CORNERS_SQL = f"""WITH {LAYOUT} SELECT task_id, page_index, block_no,
CASE WHEN no_box THEN 0 ELSE bx1 END AS x1, CASE WHEN no_box THEN 0 ELSE by1 END AS y1,
CASE WHEN no_box THEN 0 ELSE bx2 END AS x2, CASE WHEN no_box THEN 0 ELSE by2 END AS y2 FROM b"""


def bbox_scale(spark: SparkSession, sf: str) -> DataFrame:
    """The three scalings of each block by its page size."""
    w, h, box = F.col("width"), F.col("height"), F.col("bbox")
    scaled = X.block_table(spark, sf).select(
        "task_id", "page_index", "block_no", B.scale_1024(box, w, h).alias("a"),
        B.scale_999(box, w, h).alias("b"),
        B.scale_by(box.cast("array<int>"), w / F.lit(1000.0), h / F.lit(700.0)).alias("c"))
    return scaled.select("task_id", "page_index", "block_no", *[
        F.get(s, F.lit(k)).cast("double").alias(f"{s}{k}") for s in "abc" for k in range(4)])


def _scaled_sql(prefix: str, divide: int) -> str:
    def value(v: str, side: str) -> str:
        if divide == 1024:
            return f"CAST({v} AS FLOAT) * CAST(CAST({side} AS FLOAT) / CAST(1024 AS FLOAT) AS FLOAT)"
        return f"CAST(CAST({v} AS FLOAT) / CAST(999 AS FLOAT) AS FLOAT) * CAST({side} AS FLOAT)"
    missing = "NULL" if divide == 1024 else "0"
    low = [f"greatest(CAST(0 AS FLOAT), {value(v, s)})" for v, s in (("bx1", "width"), ("by1", "height"))]
    high = [f"least(CAST({s} AS FLOAT), {value(v, s)})" for v, s in (("bx2", "width"), ("by2", "height"))]
    return ", ".join(f"CAST(CASE WHEN no_box THEN {missing} ELSE {e} END AS DOUBLE) AS {prefix}{k}"
                     for k, e in enumerate(low + high))


BBOX_SCALE_SQL = f"""WITH {LAYOUT} SELECT task_id, page_index, block_no, {_scaled_sql('a', 1024)},
{_scaled_sql('b', 999)}, """ + ", ".join(
    f"CAST(CASE WHEN no_box THEN NULL ELSE trunc({v} * ({s} / CAST({d} AS DOUBLE))) END AS DOUBLE) AS c{k}"
    for k, (v, s, d) in enumerate((("bx1", "width", "1000"), ("by1", "height", "700"),
                                   ("bx2", "width", "1000"), ("by2", "height", "700")))) + " FROM b"


def bbox_union(spark: SparkSession, sf: str) -> DataFrame:
    """Box around all boxes of an embedding, four values each."""
    boxes = F.transform(F.sequence(F.lit(0), F.floor(F.size("embedding") / 4).cast("int") - 1),
                        lambda k: F.slice("embedding", k * 4 + 1, 4))
    merged = X.table(spark, sf, "embeddings").select("vec_id", B.union(boxes).alias("bbox"))
    return box_numbers(merged)


_EVERY_FOURTH = "list_transform(range(0, len(embedding) // 4), lambda k: embedding[CAST(k * 4 + {} AS INT)])"
BBOX_UNION_SQL = f"""SELECT vec_id,
CAST(list_min({_EVERY_FOURTH.format(1)}) AS DOUBLE) AS x1, CAST(list_min({_EVERY_FOURTH.format(2)}) AS DOUBLE) AS y1,
CAST(list_max({_EVERY_FOURTH.format(3)}) AS DOUBLE) AS x2, CAST(list_max({_EVERY_FOURTH.format(4)}) AS DOUBLE) AS y2
FROM embeddings"""


# ---------------------------------------------------------------------------
# Markdown
# ---------------------------------------------------------------------------
def _markdown(spark: SparkSession, sf: str, dialect: str) -> DataFrame:
    parsed = parse_responses(X.responses(spark, sf, dialect), dialect)
    return page_markdown(parsed, dialect).select("doc_id", "task_id", "page_index", "markdown")


def page_markdown_dots(spark: SparkSession, sf: str) -> DataFrame:
    return _markdown(spark, sf, "dots").select("doc_id", "markdown")


def punct_sql(expr: str) -> str:
    for mark, repl in ((r"\.", "..."), ("_", "___"), ("-", "---")):
        expr = f"regexp_replace({expr}, '{mark}{{5,}}', '{repl}', 'g')"
    return expr


_FORMULA = ("CASE WHEN left(t, 2) <> '$$' AND right(t, 2) <> '$$' "
            "THEN concat(chr(10), '$$', chr(10), t, chr(10), '$$', chr(10)) ELSE t END")
DOTS_MARKDOWN_CTES = f"""{DOTS_BLOCKS},
shown AS (SELECT doc_id, task_id, page_index, block_no, category, {trim_sql('text')} AS t FROM dots
          WHERE category NOT IN ('Page-header', 'Page-footer')),
src AS (SELECT doc_id * 100000 + block_no AS id, {punct_sql('t')} AS txt FROM shown
        WHERE category NOT IN ('Formula', 'Table', 'Picture')),
{collapse_ctes('src')},
formatted AS (SELECT s.doc_id, s.task_id, s.page_index, block_no, CASE WHEN category = 'Formula' AND t <> '' THEN {_FORMULA}
              WHEN category IN ('Formula', 'Table', 'Picture') THEN t ELSE c.txt END AS md
              FROM shown s LEFT JOIN collapsed c ON c.id = s.doc_id * 100000 + s.block_no),
joined AS (SELECT doc_id, string_agg(md, chr(10) || chr(10) ORDER BY block_no) AS md FROM formatted
           WHERE {trim_sql('md')} <> '' GROUP BY doc_id),
page_md AS (SELECT p.doc_id, p.task_id, p.page_index, coalesce({trim_sql('md')}, '') AS markdown
            FROM p LEFT JOIN joined USING (doc_id))"""
PAGE_MARKDOWN_DOTS_SQL = f"WITH RECURSIVE {DOTS_MARKDOWN_CTES} SELECT doc_id, markdown FROM page_md"


def page_markdown_deepseek(spark: SparkSession, sf: str) -> DataFrame:
    return _markdown(spark, sf, "deepseekocr").select("doc_id", "markdown")


PAGE_MARKDOWN_DEEPSEEK_SQL = f"""WITH {DEEPSEEK_BLOCKS},
md AS (SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY block_no) AS markdown
       FROM deepseekocr GROUP BY doc_id)
SELECT doc_id, coalesce(markdown, '') AS markdown FROM p LEFT JOIN md USING (doc_id)"""


def page_markdown_chandra(spark: SparkSession, sf: str) -> DataFrame:
    return _markdown(spark, sf, "chandra").select("doc_id", "markdown")


def document_markdown(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship chain: responses, blocks, page Markdown, documents."""
    return assemble.document_markdown(_markdown(spark, sf, "dots"))


DOCUMENT_MARKDOWN_SQL = f"""WITH RECURSIVE {DOTS_MARKDOWN_CTES}
SELECT task_id, CAST(count(*) AS INT) AS pages, string_agg(concat(markdown,
  chr(10), chr(10), 'Page ', page_index + 1, chr(10), chr(10), '---', chr(10)), '' ORDER BY page_index)
  AS markdown FROM page_md GROUP BY task_id"""


def document_status(spark: SparkSession, sf: str) -> DataFrame:
    status = (F.when(F.col("doc_id") % 17 == 3, "FAILED").when(F.length("body") < 200, "BLANK")
              .otherwise("OK"))
    done = X.pages(spark, sf).select("task_id", "page_index", status.alias("page_status"))
    tasks = (X.table(spark, sf, "documents").selectExpr(X.PAGE_COLS[1]).distinct()
             .withColumn("total_pages", F.lit(8)))
    return assemble.document_status(done, tasks)


DOCUMENT_STATUS_SQL = f"""WITH {PAGES}, s AS (SELECT task_id, doc_id % 17 = 3 AS bad FROM p)
SELECT task_id, 8 AS total_pages, count(*) FILTER (WHERE NOT bad) AS good_pages,
count(*) FILTER (WHERE bad) AS failed_pages,
CASE WHEN bool_or(bad) OR count(*) <> 8 THEN 'Failed' ELSE 'Successed' END AS status
FROM s GROUP BY task_id"""


QUERIES = {
    "parse_dots": (parse_dots, PARSE_DOTS_SQL),
    "parse_deepseek": (parse_deepseek, PARSE_DEEPSEEK_SQL),
    "parse_chandra": (parse_chandra, PARSE_CHANDRA_SQL),
    "parse_json_strict": (parse_json_strict, PARSE_JSON_STRICT_SQL),
    "blocks_json": (blocks_json, PARSE_DOTS_SQL),
    "category_map": (category_map, CATEGORY_MAP_SQL),
    "picture_blocks": (picture_blocks, PICTURE_BLOCKS_SQL),
    "header_footer_filter": (header_footer_filter, HEADER_FOOTER_SQL),
    "block_dedupe": (block_dedupe, BLOCK_DEDUPE_SQL),
    "bbox_corners": (bbox_corners, BBOX_CORNERS_SQL),
    "bbox_scale": (bbox_scale, BBOX_SCALE_SQL),
    "bbox_union": (bbox_union, BBOX_UNION_SQL),
    "page_markdown_dots": (page_markdown_dots, PAGE_MARKDOWN_DOTS_SQL),
    "page_markdown_deepseek": (page_markdown_deepseek, PAGE_MARKDOWN_DEEPSEEK_SQL),
    "document_markdown": (document_markdown, DOCUMENT_MARKDOWN_SQL),
    "document_status": (document_status, DOCUMENT_STATUS_SQL),
}
