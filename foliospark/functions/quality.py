"""Response quality tests and the outcome class of one attempt."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.functions.columns import is_blank
from foliospark.operators.dialects import by_model
from foliospark.schemas import REPEAT_RANGE, REPEAT_WINDOW, RUNAWAY_TOKENS


def is_repetitive(content: Column, window: int = REPEAT_WINDOW) -> Column:
    """The last ``window`` characters occur in the up to 2000 characters before them."""
    n = F.length(content)
    start = F.greatest(n - window - REPEAT_RANGE, F.lit(0))
    before = F.substr(content, start + 1, F.least(n - window, F.lit(REPEAT_RANGE)))
    return F.coalesce((n >= 2 * window) & F.contains(before, F.right(content, F.lit(window))),
                      F.lit(False))


def is_length_limited(finish_reason: Column) -> Column:
    return F.coalesce(F.lower(finish_reason) == "length", F.lit(False))


def outcome(model: Column, content: Column, finish_reason: Column, token_count: Column,
            error: Column) -> Column:
    """Outcome class of one attempt, first match wins. Only a dialect with a strict parse can
    give PARSE_ERROR; the others swallow bad pieces."""
    limited = is_length_limited(finish_reason)
    cleaned = by_model(lambda d, _: d.clean(content), model, content)
    parsed = by_model(lambda d, _: d.strict(content) if d.strict else None, model, F.lit(True))
    return (F.when(error.isNotNull(), "API_ERROR")
            .when(is_repetitive(content), "REPETITION")
            .when(limited & (token_count > RUNAWAY_TOKENS), "RUNAWAY")
            .when(limited, "LENGTH")
            .when(is_blank(cleaned), "EMPTY")
            .when(~parsed, "PARSE_ERROR")
            .otherwise("OK"))
