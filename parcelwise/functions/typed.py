"""Raw text to typed values, as column expressions.

``parse_*`` functions return ``struct<value, bad>``: a null token gives a null value that is not bad, any
other text that does not parse gives a null value that is bad and sends its row to quarantine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that stand for "no value", after trimming and lower-casing.
NULL_TOKENS = ("", "none", "null", "nan", "n/a", "na", "-")

# Accepted number shapes (thousands groups must be complete).
_DIGITS = r"(?:\d{1,3}(?:,\d{3})+|\d+)"
MONEY = rf"^-?\s*\$?\s*{_DIGITS}(?:\.\d+)?$"
WHOLE = rf"^-?\s*{_DIGITS}(?:\.0+)?$"
NUMBER = rf"^-?\s*{_DIGITS}(?:\.\d+)?\s*%?$"
# Fixed value: a whole number inside prose, neither part of a word or decimal nor a percentage.
INTEGER_IN_TEXT = r"(?<![\w.])\d[\d,]*(?![\w.%])"

WHITESPACE = " \t\n\r\f\x0b"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def clean(c: Column) -> Column:
    """Trimmed text, or null for a null token."""
    text = strip(c)
    return F.when(~F.lower(text).isin(*NULL_TOKENS), text)


def _parsed(text: Column, value: Column) -> Column:
    return F.struct(value.alias("value"), (text.isNotNull() & value.isNull()).alias("bad"))


def _number(text: Column, pattern: str) -> Column:
    return F.when(text.rlike(pattern), F.regexp_replace(text, r"[$,%\s]", "").try_cast("double"))


def money(text: Column) -> Column:
    return _number(text, MONEY)


def number(text: Column) -> Column:
    """A trailing percent sign is dropped; the number is not divided by 100."""
    return _number(text, NUMBER)


def whole(text: Column) -> Column:
    """Whole counts; ``1,234.0`` counts as whole, ``1.5`` does not."""
    plain = F.regexp_replace(F.regexp_replace(text, r"\.0+$", ""), r"[,\s]", "")
    number = _number(text, NUMBER)
    return F.when(text.rlike(WHOLE), plain.try_cast("bigint")).otherwise(
        F.when(F.abs(number - F.rint(number)) <= 1e-9, F.rint(number).cast("bigint"))
    )


def date(text: Column) -> Column:
    """ISO dates and datetimes, or month/day/year."""
    return (
        F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd"))
        .when(text.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_date(text, "M/d/yyyy"))
        .when(text.rlike(r"^\d{8}(T.*)?$"), F.try_to_date(F.substring(text, 1, 8), "yyyyMMdd"))
    )


def parse_money(c: Column) -> Column:
    return _parsed(clean(c), money(clean(c)))


def parse_number(c: Column) -> Column:
    return _parsed(clean(c), number(clean(c)))


def parse_whole(c: Column) -> Column:
    return _parsed(clean(c), whole(clean(c)))


def parse_date(c: Column) -> Column:
    return _parsed(clean(c), date(clean(c)))


def plain_id(c: Column) -> Column:
    """Numeric ids without leading zeros or a ``.0`` tail; other ids as they are."""
    text = F.regexp_replace(clean(c), r"^(\d+)\.0+$", "$1")
    return F.when(text.rlike(r"^\d+$"), F.regexp_replace(text, r"^0+(?=\d)", "")).otherwise(text)


def upper_id(c: Column) -> Column:
    return F.upper(clean(c))


def tidy_name(c: Column) -> Column:
    return F.regexp_replace(clean(c), r"\s+", " ")


def zip5(c: Column) -> Column:
    """Five-digit code: pad a bare number, otherwise the first run of five digits."""
    text = strip(c)
    found = F.regexp_extract(text, r"(\d{5})", 1)
    return F.when(
        text.rlike(r"^\d+$"), F.when(F.length(text) < 5, F.lpad(text, 5, "0")).otherwise(text)
    ).otherwise(F.when(found != "", found))


def padded_code(c: Column, width: int = 2) -> Column:
    """Zero-padded code; longer codes keep their length and a missing code is all zeros."""
    text = F.coalesce(F.btrim(c), F.lit(""))
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def answer(c: Column) -> Column:
    """Survey answer codes to yes / no / not_applicable / unknown."""
    text = F.btrim(c)
    return (
        F.when(text == "1", "yes").when(text == "2", "no").when(text == "-2", "not_applicable").otherwise("unknown")
    )


def finite(c: Column) -> Column:
    """The number as double, or null when it is missing, NaN or infinite."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def size_bucket(c: Column, low: int, high: int, top: int = 4) -> Column:
    """Whole number in ``low..high`` as text, top-coded as ``<top>+``; anything else is null."""
    x = finite(c)
    inside = (x == F.floor(x)) & x.between(low, high)
    return F.when(inside, F.when(x < top, x.cast("int").cast("string")).otherwise(f"{top}+"))


def integers(c: Column) -> Column:
    """All whole numbers of a text line, in order."""
    found = F.regexp_extract_all(c, F.lit(INTEGER_IN_TEXT), F.lit(0))
    return F.transform(found, lambda x: F.regexp_replace(x, ",", "").cast("bigint"))


def months_apart(a: Column, b: Column) -> Column:
    """Distance in calendar months; days of the month do not matter."""
    return F.abs((F.year(a) - F.year(b)) * 12 + F.month(a) - F.month(b))


def search_text(c: Column) -> Column:
    """Lower case, every run of other characters becomes one space."""
    return F.btrim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " "))


def joined_id(*parts: Column | str) -> Column:
    """Deterministic id from a template of literals (str) and columns."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def code_of(c: Column, codes: dict[str, str]) -> Column:
    """Lookup in a small fixed code list, on the upper-cased trimmed text."""
    pairs = [F.lit(x) for pair in codes.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), F.upper(F.btrim(c)))
