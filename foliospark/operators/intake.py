"""Uploads: validation, model resolution, naming, page fan-out, conflicts, cancellation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.columns import trimmed
from foliospark.schemas import models


def resolve_models(uploads: DataFrame, settings: DataFrame | None = None) -> DataFrame:
    """Join the model settings: the id is matched ignoring case but not outer blanks, while the
    queue name is trimmed and lowered. The list of supported models is a fixed local relation; the
    ``settings`` of a deployment (model_id, model_name, concurrency) may lack some of them."""
    supported = models(uploads.sparkSession)
    given = (supported if settings is None else settings).select(
        F.lower("model_id").alias("_key"), "model_name", "concurrency")
    known = supported.select(F.lower("model_id").alias("_key"), F.lit(True).alias("_known"))
    return (uploads.withColumn("_key", F.lower("model_id"))
            .join(known.join(given, "_key", "left"), "_key", "left").drop("_key")
            .withColumn("queue", F.lower(trimmed(F.col("model_id"))))
            .withColumn("supported", F.col("_known").isNotNull()).drop("_known"))


def reject_reason() -> Column:
    """First failing check of an upload, null when it is accepted.

    Expects length, model_id, model_name, file_exists, stored_length, readable, total_pages."""
    return (F.when(F.col("length").isNull() | (F.col("length") == 0), "NO_FILE")
            .when(~F.col("supported"), "UNSUPPORTED_MODEL")
            .when(F.col("concurrency").isNull(), "NO_MODEL_CONFIG")
            .when(~F.coalesce("file_exists", F.lit(False)), "FILE_NOT_FOUND")
            .when(F.coalesce("stored_length", F.lit(0)) == 0, "EMPTY_FILE")
            .when(~F.coalesce("readable", F.lit(False)), "UNREADABLE")
            .when(F.coalesce("total_pages", F.lit(0)) <= 0, "NO_PAGES"))


def validate_uploads(uploads: DataFrame, settings: DataFrame | None = None) -> DataFrame:
    return resolve_models(uploads, settings).withColumn("reject_reason", reject_reason())


def task_id(host: Column, *content: Column) -> Column:
    """Host without punctuation, lowered, and a content hash (so a rerun gives the same id)."""
    return F.concat_ws("-", F.lower(F.regexp_replace(host, "[^a-zA-Z0-9]", "")),
                       F.sha2(F.concat_ws("\u0001", *content), 256))


def output_name(stem: Column, task: Column) -> Column:
    """File stem without its task-id prefix and the underscores that follow it."""
    cut = F.regexp_replace(F.substr(stem, F.length(task) + 1), r"\A_+", "")
    return F.when(F.startswith(stem, task), cut).otherwise(stem)


def output_file(stem: Column, task: Column, written_at: Column) -> Column:
    return F.concat(output_name(stem, task), F.lit("_"), task, F.lit("_"),
                    F.date_format(written_at, "yyyyMMdd_HHmmss"), F.lit(".md"))


def page_fanout(tasks: DataFrame) -> DataFrame:
    """One row per page 0..N-1; tasks without pages give none."""
    return tasks.filter(F.col("total_pages") > 0).withColumn(
        "page_index", F.explode(F.sequence(F.lit(0), F.col("total_pages") - 1)))


def _suffixes(stored: DataFrame) -> DataFrame:
    """Every text that follows an underscore in a stored name, once."""
    parts = F.split("stored_name", "_")
    later = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda k: F.array_join(
        F.slice(parts, k, F.size(parts)), "_"))
    return (stored.select(F.explode(F.when(F.size(parts) > 1, later)).alias("file_name"))
            .distinct())


def without_conflicts(uploads: DataFrame, stored: DataFrame, strict: bool = True) -> DataFrame:
    """Uploads whose ``file_name`` is not in use by a stored name.

    A stored name is in use when it ends with ``_`` and the file name. Instead of a suffix
    comparison of all pairs, every possible suffix of a stored name is listed once and the test is
    an equi anti join. ``strict=False`` compares with the part after the first underscore only.
    """
    taken = _suffixes(stored) if strict else stored.select(
        F.regexp_replace("stored_name", r"\A[^_]*_", "").alias("file_name")).distinct()
    return uploads.join(taken, "file_name", "left_anti")


def without_cancelled(work: DataFrame, cancellations: DataFrame) -> DataFrame:
    """Work of every model that no cancellation names."""
    return work.join(cancellations.select("task_id").distinct(), "task_id", "left_anti")


def cancelled_found(work: DataFrame, cancellations: DataFrame) -> DataFrame:
    """Cancellations that hit any work, in any model."""
    return (cancellations.select("task_id").distinct()
            .join(work.select("task_id").distinct(), "task_id", "left_semi"))


def latest_output(outputs: DataFrame) -> DataFrame:
    """Newest Markdown output of each task, from ``{name}_{task}_{yyyyMMdd}_{HHmmss}.md`` paths."""
    task = F.regexp_extract("path", r"_([^_/]+)_\d{8}_\d{6}\.md$", 1)
    return (outputs.withColumn("task_id", task).filter(F.col("task_id") != "")
            .groupBy("task_id").agg(
                F.max_by("path", F.struct("modified", "path")).alias("path"),
                F.count("*").alias("versions")))
