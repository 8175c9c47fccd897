"""De-duplication of a block table (one row per block)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliospark.schemas import TEXT_REPEAT_CAP


def block_dedupe(blocks: DataFrame, keys: tuple[str, ...] = ("task_id", "page_index"),
                 cap: int = TEXT_REPEAT_CAP) -> DataFrame:
    """Keep the first ``cap`` blocks per (page, category, text), then the first block per
    (page, box); blocks without a box are exempt from the second rule.

    Both rules have the form ``row_number() <= literal`` (or ``rank``), which Spark turns into a group limit in
    front of the exchange: each task ships at most ``cap`` (or one) rows of a group, so a hot page
    or a hot text is cut down before the shuffle. Blocks without a box are grouped by their number,
    where all of them rank first and stay.
    """
    same_text = W.partitionBy(*keys, "category", F.coalesce("text", F.lit(""))).orderBy("block_no")
    capped = (blocks.withColumn("_n", F.row_number().over(same_text))
              .filter(F.col("_n") <= cap).drop("_n"))
    own = F.when(F.col("bbox").isNull(), F.col("block_no"))
    same_box = W.partitionBy(*keys, "bbox", own).orderBy("block_no")
    return (capped.withColumn("_n", F.rank().over(same_box))
            .filter(F.col("_n") <= 1).drop("_n"))
