"""Small helpers shared by the Column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times in ``body`` (expressions inside lambdas are
    re-evaluated per element otherwise)."""
    return F.get(F.transform(F.array(value), lambda bound: body(bound)), F.lit(0))


def literal_lookup(key: Column, table: dict[str, str], default: str) -> Column:
    """Map a key through a small fixed table (one constant map, folded at planning time)."""
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default))


# Fixed set: every character of the Unicode White_Space property.
WHITE_SPACE = ("\t\n\x0b\f\r \x85\xa0\u1680"
               "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
               "\u2028\u2029\u202f\u205f\u3000")


def trimmed(c: Column) -> Column:
    """Strip all Unicode white space from both ends (plain ``trim`` only strips U+0020)."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def left_trimmed(c: Column) -> Column:
    return F.ltrim(c, F.lit(WHITE_SPACE))


def is_blank(c: Column) -> Column:
    """True for null, empty or all-white-space text."""
    return F.coalesce(left_trimmed(c) == "", F.lit(True))
