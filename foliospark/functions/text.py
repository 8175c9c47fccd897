"""Text clean-up scalars: repeat collapsing, math tags, line de-duplication, block formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.functions.columns import is_blank, let, trimmed
from foliospark.functions.runs import each_runs_collapsed, runs_collapsed, sequences_collapsed
from foliospark.schemas import PICTURES

# The clean-up patterns and their replacements.
_PUNCT = ((r"\.{5,}", "..."), ("_{5,}", "___"), ("-{5,}", "---"))
_CHAR_RUN = r"(?d)(.)\1{9,}"
_TAG_RUN = r"(<[^>]+?)\1{2,}"
_BLOCK_MATH = r'(?sU)<math[^>]*display="block"[^>]*>\s*(.*?)\s*</math>'
_INLINE_MATH = r"(?sU)<math[^>]*>\s*(.*?)\s*</math>"
_LINE_END = r"\r\n|\n"
_JUNK_LINE = "&-"


def collapse_punct(c: Column) -> Column:
    """Five or more dots, underscores or dashes become three."""
    def collapse(t: Column) -> Column:
        out = t
        for pattern, repl in _PUNCT:
            out = F.regexp_replace(out, pattern, repl)
        return F.when(t.rlike(r"\.{5}|_{5}|-{5}"), out).otherwise(t)

    return let(c, collapse)


def collapse_chars(c: Column) -> Column:
    """One character repeated ten or more times becomes three."""
    return F.regexp_replace(c, _CHAR_RUN, "$1$1$1")


def collapse_sequences(c: Column) -> Column:
    """A sequence of two or more characters repeated five or more times becomes three.

    The pattern back-tracks over all unit lengths at every position, so it is only put to lines that hold
    such a sequence (``functions/runs.py`` finds them, with a bound for the unit that no possible one exceeds).
    """
    return sequences_collapsed(c)


def collapse_runs(c: Column) -> Column:
    """Single-character runs, then sequence runs. For texts in an array see ``each_formatted``."""
    return runs_collapsed(c)


def collapse_tags(c: Column) -> Column:
    """A broken tag prefix repeated three or more times is kept once."""
    return let(c, lambda t: F.when(t.contains("<"), F.regexp_replace(
        t, _TAG_RUN, "$1")).otherwise(t))


def math_to_latex(c: Column) -> Column:
    """Block math tags become ``$$`` blocks, then the other math tags become inline ``$..$``."""
    def convert(t: Column) -> Column:
        out = F.regexp_replace(t, _BLOCK_MATH, "\n\\$\\$\n$1\n\\$\\$\n")
        out = F.regexp_replace(out, _INLINE_MATH, " \\$$1\\$ ")
        return F.when(t.contains("<math"), out).otherwise(t)

    return let(c, convert)


def line_dedupe(c: Column) -> Column:
    """Drop a line equal to the previous kept line, ignoring case and blanks; drop ``&-`` lines.

    Blank lines stay and do not take part in the comparison. The whole step works on the row's own
    line array, so it needs no shuffle: among the lines that count, a line stays iff its normal
    form differs from the one just before it.
    """
    def numbered(t: Column) -> Column:
        return F.transform(F.split(t, _LINE_END), lambda line, i: F.struct(
            i.alias("i"), line.alias("line"), F.lower(F.replace(line, F.lit(" "))).alias("norm"),
            is_blank(line).alias("blank")))

    def dedupe(all_lines: Column) -> Column:
        counted = F.filter(all_lines, lambda x: ~x["blank"] & (x["norm"] != _JUNK_LINE))
        kept = let(counted, lambda seq: F.filter(
            seq, lambda x, j: (j == 0) | (x["norm"] != F.get(seq, j - 1)["norm"])))
        blank = F.filter(all_lines, lambda x: x["blank"])
        ordered = F.sort_array(F.concat(blank, kept))
        return F.array_join(F.transform(ordered, lambda x: x["line"]), "\n")

    single = lambda t: F.when(F.replace(t, F.lit(" ")) == _JUNK_LINE, F.lit("")).otherwise(t)
    return let(c, lambda t: F.when(t.contains("\n"), let(numbered(t), dedupe)).otherwise(single(t)))


def wrap_formula(c: Column) -> Column:
    """Wrap LaTeX in ``$$`` only when neither side carries it already."""
    return F.when(~c.startswith("$$") & ~c.endswith("$$"),
                  F.concat(F.lit("\n$$\n"), c, F.lit("\n$$\n"))).otherwise(c)


def _exempt(category: Column, mode: str) -> Column:
    return category.isin(*(["Table", "Picture"] if mode == "reference" else ["Table", *PICTURES]))


def _collapsible(category: Column, text: Column, mode: str) -> Column:
    """The text where repeats are to be collapsed, else null."""
    shown = (F.coalesce(text, F.lit("")) != "") & ~F.coalesce((category == "Formula") | _exempt(category, mode), F.lit(False))
    return F.when(shown, collapse_punct(trimmed(text)))


def _formatted(category: Column, text: Column, collapsed: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit("")).otherwise(F.coalesce(
        collapsed, let(trimmed(text), lambda t: F.when(category == "Formula", wrap_formula(t)).otherwise(t))))


def format_block(category: Column, text: Column, mode: str = "reference") -> Column:
    """Per-category formatting of one block.

    ``mode="reference"`` exempts only ``Picture`` from repeat collapsing; ``"intended"`` exempts
    every picture-like category.
    """
    return _formatted(category, text, collapse_runs(_collapsible(category, text, mode)))


def each_formatted(blocks: Column, mode: str = "reference") -> Column:
    """``format_block`` of each block of an array."""
    sources = F.transform(blocks, lambda b: _collapsible(b["category"], b["text"], mode))
    return F.zip_with(blocks, each_runs_collapsed(sources), lambda b, t: _formatted(b["category"], b["text"], t))


def data_uri(image_bytes: Column) -> Column:
    """PNG bytes as a Markdown image with an inline data URI (one line: some settings make
    ``base64`` break its output into lines)."""
    encoded = F.translate(F.base64(image_bytes), "\r\n", "")
    return F.concat(F.lit("![image](data:image/png;base64,"), encoded, F.lit(")"))
