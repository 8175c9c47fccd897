"""The chain from attempts and page sizes to documents, over pages answered by different models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.operators import chain
from foliospark.plans import fixtures as X
from foliospark.plans.layout import (CHANDRA_BLOCKS, DEEPSEEK_BLOCKS, DOTS_BLOCKS, PAGE_MARKDOWN_DEEPSEEK_SQL,
                                     PAGE_MARKDOWN_DOTS_SQL, PAGES, box_numbers)
from foliospark.plans.text import CHANDRA_MARKDOWN_SQL

# The model of each page, some of them unknown, and pages without a known size.
MODEL = ("CASE WHEN doc_id % 23 = 5 THEN 'gpt' WHEN doc_id % 23 = 6 THEN NULL WHEN doc_id % 3 = 0 THEN 'Dots' "
         "WHEN doc_id % 3 = 1 THEN 'chandra' ELSE 'DeepSeekOCR' END")
SIZED = "doc_id % 29 <> 7"


def _attempts(spark: SparkSession, sf: str) -> DataFrame:
    """One to three attempts a page: most answer at once, some after an error, some never."""
    kind = F.col("doc_id") % 3
    content = F.when(kind == 0, X.raw_dots()).when(kind == 1, X.raw_chandra()).otherwise(X.raw_deepseek())

    def tried(attempt: int, outcome: str, answer) -> F.Column:
        return F.struct(F.lit(attempt).alias("attempt"), F.lit(outcome).alias("outcome"), answer.alias("content"))

    none = F.lit(None).cast("string")
    errors = [tried(k, "API_ERROR", none) for k in (1, 2, 3)]
    tries = (F.when(F.col("doc_id") % 19 == 4, F.array(*errors))
             .when(F.col("doc_id") % 7 == 3, F.array(errors[0], tried(2, "OK", content), tried(3, "OK", F.lit("late"))))
             .otherwise(F.array(tried(1, "OK", content))))
    pages = X.pages(spark, sf).select("doc_id", "task_id", "page_index", F.expr(MODEL).alias("model_id"), tries.alias("t"))
    return pages.select("task_id", "page_index", "model_id", F.inline("t"))


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    sizes = X.table(spark, sf, "documents").filter(SIZED).selectExpr(*X.PAGE_COLS[1:5])
    return chain.chain_pages(_attempts(spark, sf), sizes)


def parse_all(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of all models with boxes by the joined page sizes; pages of unknown models stay as a row."""
    return box_numbers(chain.chain_blocks(_pages(spark, sf)))


def document_chain(spark: SparkSession, sf: str) -> DataFrame:
    return chain.chain_documents(_pages(spark, sf))


STATUS = f"""CASE WHEN doc_id % 19 = 4 THEN 'FAILED' WHEN doc_id % 23 IN (5, 6) THEN 'UNKNOWN_MODEL'
WHEN NOT ({SIZED}) AND doc_id % 3 <> 0 THEN 'NO_SIZE' ELSE 'OK' END"""
_PART = "CAST(string_split(bbox, ',')[{}] AS DOUBLE) AS {}"
_DOTS = f"""SELECT doc_id, block_no, category, text, {', '.join(_PART.format(k, n) for k, n in
            enumerate(('x1', 'y1', 'x2', 'y2'), start=1))} FROM (WITH {DOTS_BLOCKS} SELECT * FROM dots)"""
ALL_BLOCKS = f"""{PAGES}, s AS (SELECT doc_id, task_id, page_index, {MODEL} AS model_id, {STATUS} AS page_status FROM p),
every AS (
  SELECT * FROM ({_DOTS}) WHERE doc_id % 3 = 0
  UNION ALL SELECT doc_id, block_no, category, text, x1, y1, x2, y2 FROM (WITH {CHANDRA_BLOCKS} SELECT * FROM chandra) WHERE doc_id % 3 = 1
  UNION ALL SELECT doc_id, block_no, category, text, x1, y1, x2, y2 FROM (WITH {DEEPSEEK_BLOCKS} SELECT * FROM deepseekocr) WHERE doc_id % 3 = 2),
found AS (SELECT s.doc_id, task_id, page_index, model_id, page_status, block_no, category, text,
  {', '.join(f"CASE WHEN page_status = 'OK' THEN {n} END AS {n}" for n in ('x1', 'y1', 'x2', 'y2'))}
  FROM s JOIN every USING (doc_id) WHERE page_status IN ('OK', 'NO_SIZE'))"""
PARSE_ALL_SQL = f"""WITH {ALL_BLOCKS}
SELECT * EXCLUDE (doc_id) FROM found
UNION ALL SELECT task_id, page_index, model_id, page_status, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM s
WHERE page_status = 'UNKNOWN_MODEL'"""

CHAIN_SQL = f"""WITH {ALL_BLOCKS},
md AS (SELECT * FROM ({PAGE_MARKDOWN_DOTS_SQL}) WHERE doc_id % 3 = 0
  UNION ALL SELECT * FROM ({CHANDRA_MARKDOWN_SQL}) WHERE doc_id % 3 = 1
  UNION ALL SELECT * FROM ({PAGE_MARKDOWN_DEEPSEEK_SQL}) WHERE doc_id % 3 = 2),
n AS (SELECT doc_id, count(*) AS n FROM found GROUP BY doc_id)
SELECT task_id, CAST(count(*) AS INT) AS pages, CAST(sum(coalesce(n, 0)) AS BIGINT) AS blocks,
  count(*) FILTER (WHERE page_status = 'UNKNOWN_MODEL') AS unknown_pages,
  count(*) FILTER (WHERE page_status = 'FAILED') AS failed_pages,
  CASE WHEN bool_or(page_status IN ('UNKNOWN_MODEL', 'FAILED')) THEN 'Failed' ELSE 'Successed' END AS status,
  string_agg(concat(CASE WHEN page_status IN ('OK', 'NO_SIZE') THEN markdown ELSE '' END, chr(10), chr(10), 'Page ',
    page_index + 1, chr(10), chr(10), '---', chr(10)), '' ORDER BY page_index) AS markdown
FROM s JOIN md USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY task_id"""

QUERIES = {
    "parse_all": (parse_all, PARSE_ALL_SQL),
    "document_chain": (document_chain, CHAIN_SQL),
}
