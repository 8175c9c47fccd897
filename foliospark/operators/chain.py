"""From attempts and page sizes to blocks and documents, whatever model answered each page.

Attempts and sizes meet on the page key. Both are usually far larger than one task's memory and are
read again and again, so ``foliospark.sources.sinks.write_page_table`` stores them bucketed by that
key: then choosing the attempt and joining the size need no exchange, parsing is row-local, and the
one exchange left is that of the page Markdown by document. On plain files Spark adds an exchange for
each of the two.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.operators.assemble import document_markdown
from foliospark.operators.attempts import PAGE, select_attempt
from foliospark.operators.dialects import UNKNOWN_MODEL, block_rows, page_markdown, parse_responses, parse_status

#: Dialects whose boxes are pixels already.
PIXEL_MODELS = ("dots",)
NO_SIZE = "NO_SIZE"


def chain_pages(classified: DataFrame, sizes: DataFrame, mode: str = "reference") -> DataFrame:
    """One row per page: keys, model_id, page_status, width, height, blocks.

    ``classified`` holds attempts with their outcome, ``sizes`` one row (task_id, page_index, width,
    height) a page. ``page_status`` is that of the deciding attempt; where it would be OK, a null or
    unknown model gives UNKNOWN_MODEL (null blocks), and a page without a size whose boxes need one
    gives NO_SIZE (blocks with null boxes). Pages that are not OK have no blocks.
    """
    chosen = select_attempt(classified).select(*PAGE, "model_id", "content", "page_status")
    page = sizes.select(*PAGE, "width", "height")
    sized = chosen.join(page, list(PAGE), "left")
    good = F.col("page_status") == "OK"
    blind = F.col("width").isNull() | F.col("height").isNull()
    lost = blind & ~F.lower("model_id").isin(*PIXEL_MODELS)
    status = (F.when(good & (parse_status(F.col("model_id")) == UNKNOWN_MODEL), UNKNOWN_MODEL)
              .when(good & lost, NO_SIZE).otherwise(F.col("page_status")))
    pages = parse_responses(sized.withColumn("page_status", status).withColumn(
        "content", F.when(F.col("page_status").isin("OK", NO_SIZE), F.col("content"))), mode=mode)
    unboxed = F.transform("blocks", lambda b: b.withField("bbox", F.lit(None).cast("array<float>")))
    return pages.withColumn("blocks", F.when(F.col("page_status") == NO_SIZE, unboxed)
                            .when(F.col("page_status").isin("OK", UNKNOWN_MODEL), F.col("blocks"))
                            .otherwise(F.array().cast(pages.schema["blocks"].dataType)))


def chain_blocks(pages: DataFrame, *keys: str) -> DataFrame:
    """One row per block with page keys, model and status; a page of an unknown model is one row without a block."""
    return block_rows(pages, *(keys or PAGE), "model_id", "page_status", keep_unparsed=True)


def chain_documents(pages: DataFrame, keep_header_footer: bool = False) -> DataFrame:
    """One row per document: pages, blocks, pages of unknown models, failed pages, status, markdown.

    The document is Successed iff all its pages are OK, BLANK or NO_SIZE. A page without blocks has
    its page mark all the same.
    """
    counted = pages.withColumn("block_count", F.coalesce(F.size("blocks"), F.lit(0)))
    shown = page_markdown(counted, keep_header_footer=keep_header_footer)
    bad = ~F.col("page_status").isin("OK", "BLANK", NO_SIZE, UNKNOWN_MODEL)
    unknown = F.col("page_status") == UNKNOWN_MODEL
    extras = [F.sum(F.greatest("block_count", F.lit(0))).alias("blocks"), F.count_if(unknown).alias("unknown_pages"),
              F.count_if(bad).alias("failed_pages")]
    return document_markdown(shown, *extras).withColumn("status", F.when(
        (F.col("unknown_pages") == 0) & (F.col("failed_pages") == 0), "Successed").otherwise("Failed"))
