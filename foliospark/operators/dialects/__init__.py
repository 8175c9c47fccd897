"""Registry of response dialects and the operators that apply them to a response table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions import blocks as K
from foliospark.functions.columns import is_blank
from foliospark.operators.dialects import chandra, deepseek, dots


@dataclass(frozen=True)
class Dialect:
    """How one model's answers are cleaned, parsed and shown."""

    clean: Callable[[Column], Column]
    parse: Callable[..., Column]
    markdown: Callable[..., Column]  # (blocks, keep_header_footer, mode)
    strict: Callable[[Column], Column] | None = None  # ok flag where a parse can fail


def _dots_clean(content: Column) -> Column:
    # Blank input is turned into an empty list, so this dialect never yields a blank answer.
    return F.when(is_blank(content), F.lit("[]")).otherwise(content)


REGISTRY: dict[str, Dialect] = {
    "dots": Dialect(_dots_clean, dots.parse, K.dots_markdown, dots.parses),
    "chandra": Dialect(chandra.cleaned, chandra.parse,
                       lambda b, keep, mode: K.chandra_page_markdown(b, keep)),
    "deepseekocr": Dialect(deepseek.cleaned, deepseek.parse,
                           lambda b, keep, mode: K.plain_markdown(b)),
}


def register(model_id: str, dialect: Dialect) -> None:
    """Add a dialect for a further model."""
    REGISTRY[model_id] = dialect


def by_model(choose: Callable[[Dialect, Column], Column | None], model: Column, default: Column) -> Column:
    """One ``when`` branch per registered dialect, so a mixed table needs a single pass. ``choose`` also
    gets the condition of the branch: functions in Python run on every row, so they should be given
    null where another dialect is in charge."""
    chain = None
    for model_id, dialect in REGISTRY.items():
        hit = F.lower(model) == model_id
        value = choose(dialect, hit)
        if value is not None:
            chain = F.when(hit, value) if chain is None else chain.when(hit, value)
    return default if chain is None else chain.otherwise(default)


def parse_responses(responses: DataFrame, model_id: str | None = None,
                    mode: str = "reference") -> DataFrame:
    """Responses (``content``, ``width``, ``height`` and keys) with a ``blocks`` array per page.

    With ``model_id`` all rows use that dialect, otherwise each row's ``model_id`` decides, ignoring
    case; null or unknown models get null ``blocks``. The step is row-local: no shuffle, and
    ``content`` is dropped as soon as it is parsed.
    """
    def parsed(d: Dialect, hit: Column | None = None) -> Column:
        content = F.col("content") if hit is None else F.when(hit, F.col("content"))
        return d.parse(content, F.col("width"), F.col("height"), mode)

    value = parsed(REGISTRY[model_id]) if model_id else by_model(
        parsed, F.col("model_id"), F.lit(None))
    return responses.withColumn("blocks", value).drop("content")


def page_markdown(pages: DataFrame, model_id: str | None = None, keep_header_footer: bool = False,
                  mode: str = "reference") -> DataFrame:
    """Pages with a ``blocks`` array to pages with ``markdown``; row-local like the parse."""
    def shown(d: Dialect, hit: Column | None = None) -> Column:
        blocks = F.col("blocks") if hit is None else F.when(hit, F.col("blocks"))
        return d.markdown(blocks, keep_header_footer, mode)

    value = shown(REGISTRY[model_id]) if model_id else by_model(
        shown, F.col("model_id"), F.lit(None))
    return pages.withColumn("markdown", value).drop("blocks")


PARSED, UNKNOWN_MODEL = "PARSED", "UNKNOWN_MODEL"


def parse_status(model: Column) -> Column:
    """Whether a dialect is registered for a row's model; null counts as unknown."""
    return F.when(F.lower(model).isin(*REGISTRY), PARSED).otherwise(UNKNOWN_MODEL)


def block_rows(pages: DataFrame, *keys: str, keep_unparsed: bool = False) -> DataFrame:
    """One row per block: the keys, ``block_no`` in page order, ``bbox``, ``category``, ``text``.

    Pages without a block give no row. With ``keep_unparsed`` pages that no dialect parsed (null
    ``blocks``) stay as one row without a ``block_no``.
    """
    # The outer form keeps the optimizer from pushing a size test on the blocks, and with it a
    # second parse of every response, below the parsing projection.
    unparsed = F.col("blocks").isNull() if keep_unparsed else F.lit(False)
    return (pages.select(*keys, unparsed.alias("_unparsed"), F.posexplode_outer("blocks").alias("block_no", "b"))
            .filter(F.col("block_no").isNotNull() | F.col("_unparsed"))
            .select(*keys, "block_no", "b.bbox", "b.category", "b.text"))
