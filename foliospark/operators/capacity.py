"""Fair sharing of a model's concurrency among workers, and its use."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def fair_share(demands: DataFrame, limits: DataFrame) -> DataFrame:
    """Allowed slots of each worker: demand (model_id, worker_id, demand), limits (model_id,
    capacity).

    Water filling: with all demands served, everyone gets their demand; otherwise everyone gets
    at most level L and the remaining slots go, one each, to the largest demands. Equal demands
    are ordered by the md5 of the worker id.

    Workers of a model are never sorted together. The level follows from the histogram of the
    demands (one row per distinct demand), which is a partial aggregate. The remainder is settled
    on the histogram too, except inside one demand class per model; there the workers are counted
    by the leading digits of their hash, a split that a large class spreads over.
    """
    histogram = (demands.groupBy("model_id", F.col("demand").alias("d"))
                 .agg(F.count("*").alias("c")).join(limits, "model_id"))
    below = W.partitionBy("model_id").orderBy("d").rowsBetween(W.unboundedPreceding, -1)
    total = W.partitionBy("model_id")
    steps = histogram.select(
        "model_id", "d", "c", "capacity",
        F.coalesce(F.sum(F.col("d") * F.col("c")).over(below), F.lit(0)).alias("used_below"),
        F.coalesce(F.sum("c").over(below), F.lit(0)).alias("n_below"),
        F.sum("c").over(total).alias("n"), F.sum(F.col("d") * F.col("c")).over(total).alias("wanted"))
    level_here = F.floor((F.col("capacity") - F.col("used_below")) / (F.col("n") - F.col("n_below")))
    levelled = steps.withColumn("level_here", level_here).withColumn(
        "level", F.min_by(F.when(F.col("level_here") < F.col("d"), F.col("level_here")),
                          F.when(F.col("level_here") < F.col("d"), F.col("d"))).over(total))
    level = F.when(F.col("wanted") <= F.col("capacity"), F.col("d")).otherwise(
        F.least("d", F.greatest("level", F.lit(0))))
    based = levelled.withColumn("base", level)
    above = W.partitionBy("model_id").orderBy(F.desc("d")).rowsBetween(W.unboundedPreceding, -1)
    open_ = F.when(F.col("d") > F.col("base"), F.col("c")).otherwise(0)
    spare = F.col("capacity") - F.sum(F.col("base") * F.col("c")).over(total)
    classes = (based.withColumn("spare", spare)
               .withColumn("taken", F.coalesce(F.sum(open_).over(above), F.lit(0)))
               .withColumn("extra", F.when(F.col("d") > F.col("base"), F.greatest(F.lit(0), F.least(
                   F.col("c"), F.col("spare") - F.col("taken")))).otherwise(0))
               .select("model_id", F.col("d").alias("demand"), "c", "base", "extra"))

    tie = (F.col("extra") > 0) & (F.col("extra") < F.col("c"))
    marked = (demands.join(classes, ["model_id", "demand"]).withColumn("_tie", tie)
              .withColumn("_hash", F.md5("worker_id")).withColumn("_lead", F.left("_hash", F.lit(3))))
    part = ["model_id", "_tie", "_lead"]
    before = W.partitionBy("model_id").orderBy("_lead").rowsBetween(W.unboundedPreceding, -1)
    offsets = marked.filter("_tie").groupBy(*part).agg(F.count("*").alias("_k")).select(
        *part, F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_before"))
    ranked = marked.withColumn("_n", F.row_number().over(W.partitionBy(*part).orderBy("_hash")))
    place = F.when(F.col("_tie"), F.col("_before") + F.col("_n")).otherwise(F.lit(0))
    return ranked.join(offsets, part, "left").select(
        "model_id", "worker_id", "demand",
        (F.col("base") + (place <= F.col("extra")).cast("int") * (F.col("extra") > 0).cast("int"))
        .alias("allow"))


def capacity_usage(demands: DataFrame, limits: DataFrame) -> DataFrame:
    """Slots in use per model against its limit."""
    used = demands.groupBy("model_id").agg(F.sum("used").alias("used"), F.count("*").alias("workers"))
    return (limits.join(used, "model_id", "left")
            .select("model_id", "capacity", F.coalesce("used", F.lit(0)).alias("used"),
                    F.coalesce("workers", F.lit(0)).alias("workers"))
            .withColumn("exhausted", F.col("used") >= F.col("capacity")))
