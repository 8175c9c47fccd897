"""Adapter views: the driver tables seen as uploads, pages, responses, blocks and events.

The expressions in the ``*_COLS`` lists mean the same in Spark SQL and in the checking SQL, so each
view is stated once and used on both sides. Raw model responses are built row by row (one document
is one page), without any grouping.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.schemas import CATEGORIES
from foliospark.sources.readers import spread

PAGE_COLS = (
    "doc_id",
    "concat('t', CAST(floor(doc_id / 8) AS BIGINT)) AS task_id",
    "CAST(doc_id % 8 AS INT) AS page_index",
    "CAST(700 + doc_id % 13 * 100 AS INT) AS width",
    "CAST(900 + doc_id % 17 * 100 AS INT) AS height",
    "replace(text, chr(92), '/') AS body",
)

BLOCK_COLS = (
    "CAST(floor(l_orderkey / 256) AS BIGINT) AS task_id",
    "CAST(l_suppkey % 32 AS INT) AS page_index",
    "((l_orderkey % 256) * 8 + l_linenumber) * 100000000000000 + l_partkey * 1000 "
    "+ l_suppkey % 1000 AS block_no",
    "CASE l_partkey % 6 WHEN 0 THEN 'Text' WHEN 1 THEN 'Title' WHEN 2 THEN 'Picture' "
    "WHEN 3 THEN 'Page-header' WHEN 4 THEN 'Page-footer' ELSE 'Figure' END AS category",
    "concat(l_returnflag, l_linestatus) AS text",
    "l_partkey % 9 = 0 AS no_box",
    "CAST(l_linenumber * 10 AS INT) AS bx1",
    "CAST(l_partkey % 20 * 5 AS INT) AS by1",
    "CAST(l_linenumber * 10 + l_suppkey % 30 AS INT) AS bx2",
    "CAST(l_partkey % 20 * 5 + l_quantity - 5 AS INT) AS by2",
    "CAST(200 + l_suppkey % 50 * 40 AS INT) AS width",
    "CAST(300 + l_suppkey % 70 * 30 AS INT) AS height",
)

DIM_COLS = (
    "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
    "CAST(200 + l_partkey % 977 * 3 AS INT) AS width",
    "CAST(150 + l_suppkey * 37 % 3001 AS INT) AS height",
    "CAST(l_linenumber % 4 * 90 AS INT) AS degrees",
)

ATTEMPT_COLS = (
    "conv_id", "turn",
    "concat('c', conv_id) AS task_id",
    "CAST(0 AS INT) AS page_index",
    "CAST(turn + 1 AS INT) AS attempt",
    "CASE conv_id % 3 WHEN 0 THEN 'dots' WHEN 1 THEN 'Chandra' ELSE 'deepseekocr' END AS model_id",
    "CASE WHEN (conv_id + turn) % 11 = 0 THEN '  ' "
    "WHEN (conv_id + turn) % 7 = 0 THEN repeat(text, 40) "
    "WHEN conv_id % 3 = 0 AND (conv_id + turn) % 4 = 0 THEN replace(text, '[', '(') "
    "WHEN conv_id % 3 = 0 THEN concat('[{\"bbox\": [1, 2, 3, 4], \"text\": \"', "
    "replace(text, '\"', ' '), '\"}]') ELSE text END AS content",
    "CASE WHEN (conv_id + 2 * turn) % 5 = 0 THEN 'Length' ELSE 'stop' END AS finish_reason",
    "CAST(CASE WHEN conv_id % 10 = 3 THEN 12000 ELSE length(text) END AS INT) AS token_count",
    "CASE WHEN (conv_id * 3 + turn) % 13 = 5 THEN 'timeout' END AS error",
)

UPLOAD_COLS = (
    "doc_id",
    "concat(source, '_', lang, CAST(doc_id % 97 AS INT), '.pdf') AS file_name",
    "CASE WHEN doc_id % 41 = 0 THEN 0 ELSE n_chars END AS length",
    "CASE doc_id % 7 WHEN 0 THEN 'dots' WHEN 1 THEN 'Chandra' WHEN 2 THEN 'DEEPSEEKOCR' "
    "WHEN 3 THEN ' dots' WHEN 4 THEN 'gpt' WHEN 5 THEN 'chandra' ELSE 'Dots' END AS model_id",
    "doc_id % 19 <> 3 AS file_exists",
    "CASE WHEN doc_id % 23 = 5 THEN 0 ELSE n_chars END AS stored_length",
    "doc_id % 29 <> 6 AS readable",
    "CAST(doc_id % 12 - 1 AS INT) AS total_pages",
)

EVENT_COLS = (
    "event_id", "ts AS event_time", "user_id",
    "concat('u', user_id, '-', day(ts)) AS task_id",
    "CASE event_type WHEN 'signup' THEN 'Started' WHEN 'view' THEN 'Processing' "
    "WHEN 'click' THEN 'Processing' WHEN 'purchase' THEN 'Successed' "
    "ELSE CASE WHEN CAST(regexp_extract(props, '[0-9]+', 0) AS INT) < 50 THEN 'Canceled' "
    "ELSE 'Failed' END END AS status",
    "CASE WHEN event_id % 10 = 9 THEN 'SaveLog' ELSE 'Logging' END AS event_type",
    "concat(event_type, ' ', regexp_extract(props, '[0-9]+', 0)) AS message",
    "concat('file', user_id, '.pdf') AS filename",
    "CASE WHEN event_type IN ('view', 'click', 'purchase') THEN value END AS processing_time",
    "CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS page_index",
    "CAST(100 + user_id % 7 AS INT) AS total_pages",
    "CASE user_id % 3 WHEN 0 THEN 'dots' WHEN 1 THEN 'chandra' ELSE 'deepseekocr' END AS model_id",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str, columns: tuple[str, ...]) -> DataFrame:
    return table(spark, sf_dir, name).selectExpr(*columns)


def cte(name: str, source: str, columns: tuple[str, ...]) -> str:
    """The same view as a common table expression of the checking SQL."""
    return f"{name} AS (SELECT {', '.join(columns)} FROM {source})"


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page per document, spread over the cores when the file is a single split."""
    source = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return source.selectExpr(*PAGE_COLS)


def block_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "lineitem", BLOCK_COLS)
    box = F.array(*[F.col(c).cast("float") for c in ("bx1", "by1", "bx2", "by2")])
    return rows.withColumn("bbox", F.when(~F.col("no_box"), box))


# Line-level layout shared by the raw responses and their checking SQL: line number ``i`` of
# document ``doc_id``. ``n``, ``i`` and ``line`` are 0-based position, count and text.
LINE_LABEL = {
    "dots": ("Text", "Title", "Page-header", "Picture", "Formula", "Table", "PageHeader"),
    "deepseekocr": ("text", "title", "sub_title", "table", "grid", "image", "list"),
    "chandra": ("Text", "Section-Header", "Page-Header", "Image", "Table", "Unknown", "Form"),
}


def label_of(dialect: str, i: Column) -> Column:
    names = F.array(*[F.lit(n) for n in LINE_LABEL[dialect]])
    turn = ((F.floor(i / 4) + F.col("doc_id")) % 7).cast("int")
    return F.when(i % 4 == 3, F.get(names, turn)).otherwise(F.lit(LINE_LABEL[dialect][0]))


def label_sql(dialect: str) -> str:
    """The same label from ``i`` and ``doc_id`` in the checking SQL."""
    names = ", ".join(f"'{n}'" for n in LINE_LABEL[dialect])
    return (f"CASE WHEN i % 4 = 3 THEN ([{names}])[CAST((CAST(floor(i / 4) AS BIGINT) + doc_id) % 7 "
            f"AS INT) + 1] ELSE '{LINE_LABEL[dialect][0]}' END")


def _numbers(i: Column, *values: Column) -> Column:
    return F.concat_ws(", ", *[v.cast("int").cast("string") for v in values])


def _box(i: Column) -> tuple[Column, ...]:
    """Four coordinates that come back every 20 lines."""
    k = i % 20
    return k * 7, k * 11, k * 7 + 100, k * 11 + 30


def _lines() -> Column:
    return F.split("body", "\n")


def raw_dots() -> Column:
    """JSON-ish response: intact, fenced, without commas or cut off, by document."""
    kind = F.col("doc_id") % 4

    def item(line: Column, i: Column) -> Column:
        x1, y1, x2, y2 = _box(i)
        numbers = F.when(i % 11 == 10, _numbers(i, x1, y1, x2)).otherwise(_numbers(i, x1, y1, x2, y2))
        return F.concat(F.lit('{"bbox": ['), numbers, F.lit('], "category": "'), label_of("dots", i),
                        F.lit('", "text": "'), F.replace(line, F.lit('"'), F.lit('\\"')), F.lit('"}'))

    items = F.transform(_lines(), item)
    body = F.concat(F.lit("["), F.when(kind == 2, F.array_join(items, " ")).otherwise(
        F.array_join(items, ", ")), F.lit("]"))
    return (F.when(kind == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
            .when(kind == 3, F.substr(body, F.lit(1), F.length(body) - 3)).otherwise(body))


def raw_json() -> Column:
    """Strict JSON array with boxes, repeated keys and numbered categories; for some documents with a defect."""
    kind = F.col("doc_id") % 5

    def item(line: Column, i: Column) -> Column:
        quoted = F.to_json(F.struct(line.alias("t")))
        category = (F.when(kind == 3, '"Nonsense"').when(i % 3 == 0, str(CATEGORIES.index("Section-header")))
                    .when(i % 3 == 1, '"section-HEADER"').otherwise('"Title","category":"Section-header"'))
        return F.concat(F.lit('{"text":5,"bbox":['), _numbers(i, *_box(i)), F.lit('.5],"category":'), category, F.lit(',"text":'),
                        F.substr(quoted, F.lit(6), F.length(quoted) - 6), F.lit("}"))

    good = F.concat(F.lit("["), F.array_join(F.transform(_lines(), item), ", "), F.lit("]"))
    return (F.when(kind == 1, F.concat(good, F.lit(" trailing")))
            .when(kind == 2, F.concat(F.lit("  "), good, F.lit("\n")))
            .when(kind == 4, F.col("body")).otherwise(good))


def raw_deepseek() -> Column:
    """Tagged response; one document in 29 has no tag at all, one line in 13 an unreadable box."""
    def item(line: Column, i: Column) -> Column:
        x1, y1, x2, y2 = _box(i)
        det = F.concat(F.lit("[["), _numbers(i, x1, y1, x2, y2), F.lit("],["),
                       _numbers(i, x1 + 5, y1 - 3, x2 + 9, y2 - 1), F.lit("]]"))
        return F.concat(F.lit("<|ref|>"), label_of("deepseekocr", i), F.lit("<|/ref|><|det|>"),
                        F.when(i % 13 == 12, "oops").otherwise(det), F.lit("<|/det|>"), line)

    tagged = F.concat(F.lit("lead "), F.array_join(F.transform(_lines(), item), "\n"),
                      F.lit("<｜end▁of▁sentence｜>"))
    return F.when(F.col("doc_id") % 29 == 0, F.col("body")).otherwise(tagged)


def raw_chandra() -> Column:
    """HTML response; one document in 5 wraps all blocks in an outer one, one line in 9 has a
    broken box."""
    def item(line: Column, i: Column) -> Column:
        box = F.concat(F.lit("["), _numbers(i, *_box(i)), F.lit("]"))
        return F.concat(F.lit('<div data-bbox="'), F.when(i % 9 == 8, "bad").otherwise(box),
                        F.lit('" data-label="'), label_of("chandra", i), F.lit('"><p>'), line,
                        F.lit("</p></div>"))

    inner = F.array_join(F.transform(_lines(), item), "\n")
    outer = F.concat(F.lit('<div data-bbox="[0,0,1024,512]" data-label="Complex-Block">'), inner,
                     F.lit("</div>"))
    return F.when(F.col("doc_id") % 5 == 0, outer).otherwise(
        F.concat(F.lit("```html\n"), inner, F.lit("\n```")))


RAW = {"dots": raw_dots, "deepseekocr": raw_deepseek, "chandra": raw_chandra}


def responses(spark: SparkSession, sf_dir: str, dialect: str) -> DataFrame:
    """Page keys, size and one raw response of the dialect per page."""
    return pages(spark, sf_dir).withColumn("content", RAW[dialect]()).drop("body")
