"""The tag dialect: ``<|ref|>label<|/ref|><|det|>[[..]]<|/det|>text`` up to the next tag."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.functions import bbox as B
from foliospark.functions.columns import is_blank, left_trimmed, let, literal_lookup, trimmed
from foliospark.schemas import DEEPSEEK_LABELS

_END_TOKEN = "<｜end▁of▁sentence｜>"  # fixed model token
_TAG = r"<\|ref\|>(.*?)<\|/ref\|><\|det\|>(.*?)<\|/det\|>"
_BLOCK_TYPE = "array<struct<bbox:array<float>,category:string,text:string>>"


def cleaned(content: Column) -> Column:
    return trimmed(F.replace(F.coalesce(content, F.lit("")), F.lit(_END_TOKEN)))


def category_of(label: Column) -> Column:
    return literal_lookup(F.lower(label), DEEPSEEK_LABELS, "Text")


def decoded_boxes(det: Column) -> Column:
    """A strict list of number lists, each of four numbers at least; anything else is null."""
    shape = F.regexp_replace(det, r"[^\[\]]+", "").rlike(r"\A\[(?:\[\])+\]\z")
    closed = det.rlike(r"(?s)\A\s*\[.*\]\s*\z")
    boxes = F.from_json(det, "array<array<float>>")
    good = F.forall(boxes, lambda b: (F.size(b) >= 4) & F.forall(b, lambda v: v.isNotNull()))
    return F.when(shape & closed & good, boxes)


def tagged_blocks(content: Column) -> Column:
    """struct(bbox, category, text) per tag with readable boxes; text before the first tag is
    dropped, the boxes of a tag are merged into one."""
    pieces = F.regexp_extract_all(content, F.lit(rf"(?s){_TAG}.*?(?={_TAG}|\z)"), F.lit(0))
    whole = rf"(?s)\A{_TAG}(.*)\z"

    def one(piece: Column) -> Column:
        return F.struct(
            decoded_boxes(trimmed(F.regexp_extract(piece, whole, 2))).alias("boxes"),
            category_of(trimmed(F.regexp_extract(piece, whole, 1))).alias("category"),
            trimmed(F.regexp_extract(piece, whole, 3)).alias("text"))

    return let(F.filter(F.transform(pieces, one), lambda b: b["boxes"].isNotNull()),
               lambda found: F.transform(found, lambda b: F.struct(
                   B.union(b["boxes"]).alias("bbox"), b["category"].alias("category"),
                   b["text"].alias("text")))).cast(_BLOCK_TYPE)


def titled(category: Column, text: Column) -> Column:
    """Titles get a heading mark unless they carry one."""
    plain = left_trimmed(text)
    return F.when((category == "Title") & ~plain.startswith("#"),
                  F.concat(F.lit("### "), plain)).otherwise(text)


def parse(content: Column, width: Column, height: Column, mode: str = "reference") -> Column:
    """Blocks of a response with boxes in pixels; without any usable tag the whole text is one
    ``Text`` block without a box."""
    def build(text: Column) -> Column:
        whole = F.array(F.struct(F.lit(None).cast("array<float>").alias("bbox"),
                                 F.lit("Text").alias("category"), text.alias("text")))
        found = let(tagged_blocks(text), lambda blocks: F.when(
            (F.size(blocks) == 0) & ~is_blank(text), whole.cast(_BLOCK_TYPE)).otherwise(blocks))
        return F.transform(found, lambda b: F.struct(
            F.when(b["bbox"].isNotNull(), B.scale_999(b["bbox"], width, height)).alias("bbox"),
            b["category"].alias("category"), titled(b["category"], b["text"]).alias("text")))

    return let(cleaned(content), build)
