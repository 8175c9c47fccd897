"""Pages to documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def document_markdown(pages: DataFrame, *extras: Column) -> DataFrame:
    """One row per document: its pages in order, each with its Markdown, an empty line, ``Page n``, an
    empty line and a rule; blank pages are included. ``extras`` are further named aggregates."""
    page = F.concat(F.coalesce("markdown", F.lit("")), F.lit("\n\nPage "),
                    (F.col("page_index") + 1).cast("string"), F.lit("\n\n---\n"))
    ordered = F.sort_array(F.collect_list(F.struct("page_index", page.alias("md"))))
    out = pages.groupBy("task_id").agg(ordered.alias("p"), *extras)
    return (out.withColumn("pages", F.size("p"))
            .withColumn("markdown", F.array_join(F.transform("p", lambda x: x["md"]), "")).drop("p"))


def document_status(pages: DataFrame, tasks: DataFrame) -> DataFrame:
    """Per task: good and failed pages, and success iff every page is there and OK or BLANK."""
    good = F.col("page_status").isin("OK", "BLANK")
    per_task = pages.groupBy("task_id").agg(
        F.count_if(good).alias("good_pages"), F.count_if(~good).alias("failed_pages"))
    done = (F.col("failed_pages") == 0) & (F.col("good_pages") == F.col("total_pages"))
    return (tasks.select("task_id", "total_pages").join(per_task, "task_id", "left")
            .select("task_id", "total_pages",
                    F.coalesce("good_pages", F.lit(0)).alias("good_pages"),
                    F.coalesce("failed_pages", F.lit(0)).alias("failed_pages"))
            .withColumn("status", F.when(done, "Successed").otherwise("Failed")))
