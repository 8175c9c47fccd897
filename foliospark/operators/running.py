"""Ordered running values that do not gather a key into one task.

A window over a hot key sorts that key in a single task. Here rows are dealt to ranges of (key,
order), so a key with many rows lies in several ranges whatever its values are; rows are numbered
within (key, range), the totals of the ranges are summed over the key, and the two are added. Only
the range totals of a key ever meet in one task. The dealt rows are stored, so every branch and every
recomputed task sees the same ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliospark.operators.lineage import cut


def dealt(df: DataFrame, keys: list[str], order: list[str], ranges: int | None = None) -> DataFrame:
    """The rows with ``_range``, the number of their range of (keys, order); a higher number is later."""
    by = [*keys, *order]
    spread = df.repartitionByRange(ranges, *by) if ranges else df.repartitionByRange(*by)
    return cut(spread.withColumn("_range", F.spark_partition_id()))


def _joined(rows: DataFrame, per_range: DataFrame, part: list[str]) -> DataFrame:
    named = per_range.withColumnsRenamed({c: f"_k{i}" for i, c in enumerate(part)})
    on = [rows[c].eqNullSafe(named[f"_k{i}"]) for i, c in enumerate(part)]
    return rows.join(named, on)


def running_sums(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column],
                 totals: dict[str, str] | None = None, ranges: int | None = None) -> DataFrame:
    """Add inclusive running sums over ``keys`` in ``order``, nulls first.

    ``sums`` maps a new column to the value it adds up; ``totals`` maps a new column to the name
    of the sum whose whole-key total it holds. ``ranges`` is the number of ranges, else the session's
    shuffle partitions.
    """
    part = [*keys, "_range"]
    base = dealt(df.select("*", *[v.alias(f"_v_{name}") for name, v in sums.items()]), keys, order, ranges)
    inner = W.partitionBy(*part).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    local = base.select("*", *[F.sum(f"_v_{n}").over(inner).alias(f"_l_{n}") for n in sums])

    before = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*keys)
    per_range = base.groupBy(*part).agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in sums])
    offsets = per_range.select(
        *part, *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums],
        *[F.sum(f"_s_{n}").over(whole).alias(new) for new, n in (totals or {}).items()])
    return _joined(local, offsets, part).select(
        *df.columns, *[(F.col(f"_l_{n}") + F.col(f"_o_{n}")).alias(n) for n in sums],
        *(totals or {}))


def previous_value(df: DataFrame, keys: list[str], order: list[str], name: str, value: str,
                   ranges: int | None = None) -> DataFrame:
    """Add ``name``: ``value`` of the preceding row of the key in ``order``, nulls first."""
    part = [*keys, "_range"]
    base = dealt(df, keys, order, ranges)
    local = base.withColumn("_prev", F.lag(value).over(W.partitionBy(*part).orderBy(*order)))
    lasts = base.groupBy(*part).agg(F.max_by(value, F.struct(*order)).alias("_last"))
    carried = lasts.select(*part, F.lag("_last").over(
        W.partitionBy(*keys).orderBy("_range")).alias("_carry"))
    return _joined(local, carried, part).select(
        *df.columns, F.coalesce("_prev", "_carry").alias(name))
