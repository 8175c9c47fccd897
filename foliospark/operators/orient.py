"""Orientation results applied to pages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliospark.schemas import ORIENTATION_BATCH


def predictions(batches: DataFrame) -> DataFrame:
    """Batch JSON (``task_id``, ``batch_json``) to (task_id, pos, rotation, confidence)."""
    # The outer form keeps the optimizer from repeating the JSON parse in a size test.
    parsed = F.from_json("batch_json", ORIENTATION_BATCH)
    rows = batches.select("task_id", F.posexplode_outer(parsed["predictions"]).alias("pos", "p"))
    return rows.filter(F.col("pos").isNotNull()).select("task_id", "pos",
                       F.coalesce(F.expr("try_cast(p.orientation AS int)"), F.lit(0)).alias("rotation"),
                       F.col("p.confidence").alias("confidence"))


def apply_orientation(pages: DataFrame, batches: DataFrame) -> DataFrame:
    """Rotation of each page: the k-th prediction belongs to the k-th page that has an image.

    Surplus predictions or pages are ignored; the default is 0. The pages of one document are numbered in
    one task, which also has to hold its Markdown later: one exchange by task and the two of the join.
    """
    seen = F.count_if("has_image").over(W.partitionBy("task_id").orderBy("page_index"))
    keyed = pages.withColumn("pos", F.when(F.col("has_image"), (seen - 1).cast("int")))
    return (keyed.join(predictions(batches), ["task_id", "pos"], "left")
            .withColumn("rotation", F.coalesce("rotation", F.lit(0)))
            .withColumn("correction", -F.col("rotation"))
            .select(*pages.columns, "rotation", "correction"))


def predict_orientation(images: DataFrame, predict: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """Plug point for an orientation model, called with batches of (task_id, page_index, image)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield predict(batch)[["task_id", "page_index", "orientation", "confidence"]]

    return images.mapInPandas(
        run, "task_id string, page_index int, orientation string, confidence double")
