"""Sinks: documents, quarantined responses and the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foliospark.operators.intake import output_file


def write_documents(documents: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Documents as a table, clustered by task so that a lookup reads few files."""
    (documents.repartitionByRange("task_id").sortWithinPartitions("task_id")
     .write.mode(mode).parquet(path))


def write_page_table(pages: DataFrame, name: str, buckets: int, path: str | None = None, mode: str = "overwrite") -> None:
    """A table bucketed and sorted by page key. Attempts and sizes written with the same number of buckets
    are grouped and joined by page without an exchange."""
    (pages.repartition(buckets, "task_id", "page_index").write.mode(mode)
     .bucketBy(buckets, "task_id", "page_index").sortBy("task_id", "page_index")
     .saveAsTable(name, **({"path": path} if path else {})))


def write_page_images(images: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Decoded page images in a folder a page (``task_id``, ``page_index``), as rendered pages are kept. A join
    on the page key then reads the folders of its pages only."""
    (images.repartition("task_id").write.mode(mode).partitionBy("task_id", "page_index").parquet(path))


def with_file_name(documents: DataFrame, written_at) -> DataFrame:
    """Add the output file name: clean stem, task id and time stamp."""
    return documents.withColumn("file_name", output_file(F.col("file_stem"), F.col("task_id"), written_at))


def export_markdown(documents: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Markdown text files, one folder per output file. The writer ends a document with a line end,
    so the document's own last one is left out."""
    (documents.repartitionByRange("file_name")
     .select("file_name", F.regexp_replace("markdown", r"\n\z", "").alias("value"))
     .write.mode(mode).partitionBy("file_name").text(path))


def write_quarantine(bad: DataFrame, path: str, mode: str = "append") -> None:
    """Bad responses, one folder per reason."""
    bad.write.mode(mode).partitionBy("reason").parquet(path)


def append_events(encoded: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Encoded events (task_id, value) appended to a parquet log; runs until the input is used up."""
    return (encoded.writeStream.format("parquet").option("path", path)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
