"""The JSON-ish dialect: an often broken array of {bbox, category, text} objects.

Everything works on the response row itself: the text is cut into segments at each ``"bbox": [``
marker, each segment is recovered on its own, and the page's blocks stay one array column.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from foliospark.functions.bbox import four_or_null
from foliospark.functions.blocks import dedupe
from foliospark.functions.columns import is_blank, let, literal_lookup, trimmed
from foliospark.schemas import CATEGORIES

_BLOCK_TYPE = "array<struct<bbox:array<float>,category:string,text:string>>"

# The patterns of the response format and the characters stripped from both ends of
# recovered text. The quoted text uses possessive quantifiers, which match the same without
# recursion.
_FENCE = r"(?sU)```json\s*(.*?)\s*```"
_MARKER = r'(?U)"bbox"\s*:\s*\['
_LETTER = r"a-zA-Z\u00C0-\u1EF9"
_CATEGORY = r'(?U)"category"\s*:\s*"([^"]+)"'
_TEXT = r'(?U)"text"\s*:\s*"([^"\\]*+(?:\\[^\n][^"\\]*+)*+)"?'
_FRAGMENTS = (r'(?iU)"category"\s*:\s*"[^"]*"?,?', r'(?iU)"text"\s*:\s*"?,?', r'(?iU)"bbox"\s*:\s*\[?,?')
_EDGE = ' ,{}\r\n\t":[])(，'


def unfenced(content: Column) -> Column:
    """The body of the first ```json fence, or the trimmed text when there is none."""
    return let(trimmed(content), lambda t: F.when(
        t.contains("```json") & t.rlike(_FENCE), F.regexp_extract(t, _FENCE, 1)).otherwise(t))


def category_of(name: Column, mode: str = "reference") -> Column:
    """Category by member name, ignoring case and outer blanks.

    Reference behaviour knows only the names without hyphens, so ``Page-header`` becomes ``Text``;
    ``mode="intended"`` ignores hyphens.
    """
    key = F.lower(trimmed(name))
    if mode == "intended":
        key = F.replace(key, F.lit("-"))
    return literal_lookup(key, {c.replace("-", "").lower(): c for c in CATEGORIES}, "Text")


def _recover(segment: Column, mode: str) -> Column:
    """One segment to struct(bbox, category, text)."""
    return let(F.substr(segment, F.instr(segment, "[")), lambda tail: _fields(segment, tail, mode))


def _fields(segment: Column, tail: Column, mode: str) -> Column:
    lead = F.regexp_extract(tail, rf"\A[^{_LETTER}]*+", 0)
    numbers = F.slice(F.regexp_extract_all(lead, F.lit(r"([0-9]+)"), F.lit(1)), 1, 4)
    bbox = F.when(F.size(numbers) > 0, numbers.cast("array<float>"))
    box_text = F.regexp_extract(tail, rf"\A(?:[^0-9{_LETTER}]*+[0-9]++){{1,4}}", 0)

    name = F.regexp_extract(segment, _CATEGORY, 1)
    quoted = F.regexp_extract(segment, _TEXT, 1)

    rest = F.when(F.length(box_text) > 0,
                  F.substr(tail, F.length(box_text) + 1)).otherwise(segment)
    for fragment in _FRAGMENTS:
        rest = F.regexp_replace(rest, fragment, "")
    rest = F.btrim(rest, F.lit(_EDGE))

    text = let(F.when(~is_blank(quoted), quoted).otherwise(rest), lambda t: F.replace(
        F.when(t.endswith('"'), F.substr(t, F.lit(1), F.length(t) - 1)).otherwise(t),
        F.lit('\\"'), F.lit('"')))
    return F.struct(bbox.alias("bbox"), category_of(name, mode).alias("category"),
                    text.alias("text"))


def recovered_blocks(body: Column, mode: str = "reference") -> Column:
    """All blocks of an unfenced response, before sanitising; empty when no marker is present."""
    segments = F.filter(F.split(body, rf"(?={_MARKER})"), lambda s: s.rlike(rf"\A{_MARKER}"))
    return F.transform(segments, lambda s: _recover(trimmed(s), mode)).cast(_BLOCK_TYPE)


def sanitised(blocks: Column) -> Column:
    """Boxes of any length but four become null."""
    return F.transform(blocks, lambda b: F.struct(
        four_or_null(b["bbox"]).alias("bbox"), b["category"].alias("category"),
        b["text"].alias("text")))


def _typed(element: Column, path: str, allowed: str) -> Column:
    kind = F.schema_of_variant(F.try_variant_get(element, path, "variant"))
    return F.coalesce(kind.rlike(allowed), F.lit(True))


def _number(element: Column) -> Column:
    """A category written as a whole number, else null."""
    kind = F.schema_of_variant(F.try_variant_get(element, "$.category", "variant"))
    return F.when(kind == "BIGINT", F.try_variant_get(element, "$.category", "long"))


def _valid(element: Column) -> Column:
    """An object whose known fields have the right type; unknown fields do not matter."""
    box = F.try_variant_get(element, "$.bbox", "array<float>")
    number = _number(element)
    category = F.when(number.isNull(), F.lower(F.try_variant_get(element, "$.category", "string")))
    return (F.schema_of_variant(element).startswith("OBJECT")
            & _typed(element, "$.bbox", r"^(VOID|ARRAY<(VOID|BIGINT|DOUBLE|FLOAT|DECIMAL.*)>)$")
            & _typed(element, "$.category", "^(VOID|STRING|BIGINT)$")
            & F.coalesce(number.between(-(1 << 31), (1 << 31) - 1), F.lit(True))
            & _typed(element, "$.text", "^(VOID|STRING)$")
            & F.coalesce(F.forall(box, lambda v: v.isNotNull()), F.lit(True))
            & F.coalesce(category.isin(*[c.lower() for c in CATEGORIES]), F.lit(True)))


def _read(element: Column) -> Column:
    number = _number(element)
    known = F.get(F.array(*[F.lit(c) for c in CATEGORIES]), F.when(number.between(0, len(CATEGORIES) - 1), number).cast("int"))
    category = F.lower(F.try_variant_get(element, "$.category", "string"))
    has_text = F.try_variant_get(element, "$.text", "variant").isNotNull()
    return F.struct(
        F.try_variant_get(element, "$.bbox", "array<float>").alias("bbox"),
        F.when(number.isNotNull(), F.coalesce(known, number.cast("string")))
        .when(category.isNotNull(), literal_lookup(
            category, {c.lower(): c for c in CATEGORIES}, "Text")).alias("category"),
        F.when(has_text, F.try_variant_get(element, "$.text", "string"))
        .otherwise(F.lit("")).alias("text"))


def _elements(content: Column) -> Column:
    """The elements of a strict JSON array, null for anything else.

    The parser reads one value and ignores what follows. What follows the array would have to begin
    with a bracket to pass inside an array, with a brace to pass inside an object, so nothing passes both.
    Of repeated keys the last one counts, which the session's JSON reader has to be told.
    """
    session = SparkSession.getActiveSession()
    if session:
        session.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    inside = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), content, F.lit("]"))), "$", "array<variant>")
    alone = (F.size(inside) == 1) & F.try_parse_json(F.concat(F.lit('{"v":'), content, F.lit("}"))).isNotNull()
    return F.when(content.rlike(r"(?sU)\A\s*\[.*\]\s*\z") & alone,
                  F.try_variant_get(F.get(inside, F.lit(0)), "$", "array<variant>"))


def _all_valid(elements: Column) -> Column:
    return elements.isNotNull() & F.coalesce(F.forall(elements, _valid), F.lit(False))


def _result(ok: Column, blocks: Column) -> Column:
    return F.struct(ok.alias("ok"), blocks.cast(_BLOCK_TYPE).alias("blocks"))


def strict_json(content: Column) -> Column:
    """struct(ok, blocks): a strict JSON array of block objects, or ok = false.

    A bare object, prose, an unknown category or a wrongly typed field is an error. A category may be
    the number of its name; a whole number without a name stays as it is written. Types are read
    from the parsed variant, since a cast would quietly turn them into null.
    """
    return let(_elements(content), lambda elements: let(_all_valid(elements), lambda ok: _result(
        ok, F.when(ok, F.transform(elements, _read)).otherwise(F.array().cast(_BLOCK_TYPE)))))


def _bracketed(body: Column) -> Column:
    return F.when(body.startswith("["), body).otherwise(F.concat(F.lit("["), body, F.lit("]")))


def cleaned(content: Column, mode: str = "reference") -> Column:
    """struct(ok, blocks) of a response: blank gives no block, marked text is recovered, capped
    and de-duplicated, unmarked text (bracketed if need be) has to be strict JSON."""
    def choose(body: Column) -> Column:
        return (F.when(body == "", _result(F.lit(True), F.array()))
                .when(body.rlike(_MARKER), _result(
                    F.lit(True), dedupe(sanitised(recovered_blocks(body, mode)))))
                .otherwise(strict_json(_bracketed(body))))

    return let(unfenced(F.coalesce(content, F.lit(""))), choose)


def parses(content: Column) -> Column:
    """The ok flag alone, without building blocks."""
    return let(unfenced(F.coalesce(content, F.lit(""))), lambda body: (
        F.when((body == "") | body.rlike(_MARKER), F.lit(True))
        .otherwise(let(_elements(_bracketed(body)), _all_valid))))


def parse(content: Column, width: Column | None = None, height: Column | None = None,
          mode: str = "reference") -> Column:
    """Blocks of a response; boxes stay in pixels of the sent image."""
    return cleaned(content, mode)["blocks"]
