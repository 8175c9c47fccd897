"""Operators on a page's own block array: caps, duplicates, Markdown. None of them shuffles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.functions.columns import is_blank, let, trimmed
from foliospark.functions.markup import clean_markdown, each_to_markdown
from foliospark.functions.text import each_formatted
from foliospark.schemas import HEADER_FOOTER, PICTURES, TEXT_REPEAT_CAP


def _take(blocks: Column, kept: Column) -> Column:
    """The blocks at the positions held in field ``i`` of ``kept``, in page order."""
    return F.transform(F.sort_array(F.transform(kept, lambda k: k["i"])),
                       lambda i: F.get(blocks, i))


def cap_repeats(blocks: Column, cap: int = TEXT_REPEAT_CAP) -> Column:
    """Keep the first ``cap`` blocks of each (category, text).

    The keys are sorted with their position; an entry is beyond the cap iff the entry ``cap``
    places before it has the same key. That is n log n, without counting maps.
    """
    def keys(all_blocks: Column) -> Column:
        return F.sort_array(F.transform(all_blocks, lambda b, i: F.struct(
            F.coalesce(b["category"], F.lit("")).alias("c"),
            F.coalesce(b["text"], F.lit("")).alias("t"), i.alias("i"))))

    def survivors(seq: Column) -> Column:
        def fresh(x: Column, j: Column) -> Column:
            earlier = F.get(seq, j - cap)
            return (j < cap) | (earlier["t"] != x["t"]) | (earlier["c"] != x["c"])
        return F.filter(seq, fresh)

    return let(blocks, lambda all_blocks: _take(
        all_blocks, let(keys(all_blocks), survivors)))


def first_per_box(blocks: Column) -> Column:
    """Keep the first block of each box; blocks without a box are exempt."""
    def keys(all_blocks: Column) -> Column:
        return F.transform(all_blocks, lambda b, i: F.struct(b["bbox"].alias("b"), i.alias("i")))

    def survivors(seq: Column) -> Column:
        boxed = let(F.sort_array(F.filter(seq, lambda x: x["b"].isNotNull())), lambda s: F.filter(
            s, lambda x, j: (j < 1) | (F.get(s, j - 1)["b"] != x["b"])))
        return F.concat(boxed, F.filter(seq, lambda x: x["b"].isNull()))

    return let(blocks, lambda all_blocks: _take(
        all_blocks, let(keys(all_blocks), survivors)))


def dedupe(blocks: Column) -> Column:
    """The text cap, then the box rule on its survivors."""
    return let(cap_repeats(blocks), first_per_box)


def without_header_footer(blocks: Column) -> Column:
    return F.filter(blocks, lambda b: ~F.coalesce(b["category"].isin(*HEADER_FOOTER), F.lit(False)))


def has_pictures(blocks: Column) -> Column:
    return F.exists(blocks, lambda b: F.coalesce(b["category"].isin(*PICTURES), F.lit(False)))


def _joined(parts: Column) -> Column:
    return trimmed(F.array_join(F.filter(parts, lambda p: ~is_blank(p)), "\n\n"))


def dots_markdown(blocks: Column, keep_header_footer: bool = False,
                  mode: str = "reference") -> Column:
    """Formatted non-blank blocks, joined by an empty line and trimmed."""
    shown = blocks if keep_header_footer else without_header_footer(blocks)
    return _joined(each_formatted(shown, mode))


def chandra_page_markdown(blocks: Column, keep_header_footer: bool = False) -> Column:
    """HTML blocks through the Markdown conversion; picture blocks are Markdown already."""
    picture = lambda b: F.coalesce(b["category"].isin(*PICTURES), F.lit(False))
    hidden = F.lit(False) if keep_header_footer else F.lit(True)
    shown = lambda b: ~(hidden & F.coalesce(b["category"].isin(*HEADER_FOOTER), F.lit(False)))
    sources = F.transform(blocks, lambda b: F.when(shown(b) & ~picture(b), F.coalesce(b["text"], F.lit(""))))
    return _joined(F.zip_with(blocks, each_to_markdown(sources), lambda b, md: F.when(
        shown(b), F.when(picture(b), F.coalesce(b["text"], F.lit(""))).otherwise(clean_markdown(md)))))


def plain_markdown(blocks: Column) -> Column:
    """All texts joined by an empty line, neither filtered nor trimmed."""
    return F.array_join(F.transform(blocks, lambda b: F.coalesce(b["text"], F.lit(""))), "\n\n")
