"""The HTML dialect: ``div`` elements with ``data-bbox`` and ``data-label``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.functions import bbox as B
from foliospark.functions.columns import literal_lookup, trimmed
from foliospark.functions.markup import divisions
from foliospark.schemas import CHANDRA_LABELS

_BLOCK_TYPE = "array<struct<bbox:array<float>,category:string,text:string>>"


def cleaned(content: Column) -> Column:
    """Remove a fence at the very start and the very end, then trim."""
    c = F.regexp_replace(F.coalesce(content, F.lit("")), r"(?iU)\A```(?:html)?\s*", "")
    return trimmed(F.regexp_replace(c, r"(?U)\s*```\n?\z", ""))


def category_of(label: Column) -> Column:
    return literal_lookup(F.lower(label), CHANDRA_LABELS, "Text")


def parse(content: Column, width: Column, height: Column, mode: str = "reference") -> Column:
    """Blocks of a response with boxes in pixels. A missing or bad box keeps the block; a nested
    division is a block of its own and also part of the outer one. Tags in comments are no tags."""
    def block(d: Column) -> Column:
        numbers = F.when(d["box"].rlike(r"(?s)\A\s*\[[^\[\]]*\]\s*\z"), F.from_json(d["box"], "array<float>"))
        good = (F.size(numbers) == 4) & F.forall(numbers, lambda v: v.isNotNull())
        return F.struct(
            F.when(good, B.scale_1024(numbers, width, height)).alias("bbox"),
            category_of(F.coalesce(d["label"], F.lit("Text"))).alias("category"),
            trimmed(d["inner"]).alias("text"))

    return F.transform(divisions(cleaned(content)), block).cast(_BLOCK_TYPE)
