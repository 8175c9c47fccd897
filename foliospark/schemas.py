"""Schemas, the layout-category domain and the fixed dimension values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

BLOCK = T.StructType([
    T.StructField("bbox", T.ArrayType(T.FloatType())),
    T.StructField("category", T.StringType()),
    T.StructField("text", T.StringType()),
])
BLOCKS = T.ArrayType(BLOCK)

RESPONSE = T.StructType([
    T.StructField("task_id", T.StringType()),
    T.StructField("page_index", T.IntegerType()),
    T.StructField("model_id", T.StringType()),
    T.StructField("attempt", T.IntegerType()),
    T.StructField("content", T.StringType()),
    T.StructField("finish_reason", T.StringType()),
    T.StructField("token_count", T.IntegerType()),
    T.StructField("error", T.StringType()),
])

ORIENTATION_BATCH = T.StructType([
    T.StructField("status", T.StringType()),
    T.StructField("predictions", T.ArrayType(T.StructType([
        T.StructField("filename", T.StringType()),
        T.StructField("orientation", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
    ]))),
    T.StructField("processed", T.IntegerType()),
    T.StructField("total_uploaded", T.IntegerType()),
])

# status and eventType arrive as integers or as names, so both are read as text.
EVENT = T.StructType([
    T.StructField("taskId", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("filename", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("eventType", T.StringType()),
    T.StructField("dataJson", T.StringType()),
    T.StructField("processingTime", T.DoubleType()),
])

# ---------------------------------------------------------------------------
# They must equal the wire format, so they are stated as they are.
# ---------------------------------------------------------------------------
CATEGORIES = (
    "Caption", "Code-block", "Complex-block", "Equation-block", "Figure", "Footnote", "Form",
    "Formula", "Image", "List-group", "List-item", "Page-footer", "Page-header", "Picture",
    "Section-header", "Table", "Table-of-contents", "Text", "Title",
)
HEADER_FOOTER = ("Page-header", "Page-footer")
PICTURES = ("Picture", "Image", "Figure")

CHANDRA_LABELS = {
    name.lower(): name
    for name in ("Caption", "Footnote", "Equation-block", "List-group", "Page-header",
                 "Page-footer", "Image", "Section-header", "Table", "Text", "Complex-block",
                 "Code-block", "Form", "Table-of-contents", "Figure")
}
DEEPSEEK_LABELS = {
    "title": "Title", "section-header": "Title", "sub_title": "Title",
    "table": "Table", "grid": "Table",
    "image": "Image", "figure": "Image", "picture": "Image",
}

EVENT_STATUS = ("Started", "Processing", "Successed", "Failed", "Canceled")
EVENT_TYPE = ("Logging", "SaveLog", "GetMarkdown")
TERMINAL_STATUS = ("Successed", "Failed", "Canceled")

MAX_ATTEMPTS = 3
BASE_MAX_TOKENS = 4096
TOKEN_STEP = 2000
PENALTY_STEP = 0.2
RUNAWAY_TOKENS = 10000
REPEAT_WINDOW = 500
REPEAT_RANGE = 2000
TEXT_REPEAT_CAP = 10

# model id, model name, concurrency limit, temperature, retry temperature, top-p,
# retry repetition penalty, prompt prefix
MODELS = (
    ("dots", "dots-ocr", 15, 0.1, 0.1, 0.9, None, "<|img|><|imgpad|><|endofimg|>"),
    ("chandra", "chandra", 30, 0.1, 0.1, 0.1, None, ""),
    ("deepseekocr", "deepseek-ocr2", 13, 0.0, 0.2, None, 1.05, "<image>\n<|grounding|>"),
)
# ---------------------------------------------------------------------------

# Prompt catalogue (our own wording): model id, mode, text.
PROMPTS = (
    ("dots", "default", "List every layout element as JSON with bbox, category and text."),
    ("dots", "layout_only", "List every layout element as JSON with bbox and category."),
    ("dots", "ocr", "Return the text of this page."),
    ("dots", "grounding", "Return the text inside the given box."),
    ("chandra", "default", "Return this page as HTML, one div with data-bbox and data-label per block."),
    ("chandra", "ocr", "Return this page as HTML."),
    ("deepseekocr", "default", "Return this document as Markdown."),
)


def _literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"
    return f"{value}D" if isinstance(value, float) else str(value)


def inline_table(spark: SparkSession, rows: tuple, columns: str) -> DataFrame:
    """A fixed table as a local relation, so Catalyst knows its size and broadcasts it by itself."""
    values = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({columns})")


def models(spark: SparkSession) -> DataFrame:
    return inline_table(spark, MODELS, "model_id, model_name, concurrency, temperature, "
                        "retry_temperature, top_p, retry_repetition_penalty, prompt_prefix")


def prompts(spark: SparkSession) -> DataFrame:
    return inline_table(spark, PROMPTS, "model_id, mode, prompt")
