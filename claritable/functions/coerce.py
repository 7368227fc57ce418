"""Typed readings of text cells: numbers, timestamps and booleans.

A reading is NULL where the text does not parse; nothing here raises, so the same
expressions measure a column (``count(number(c))``) and rewrite it.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from claritable import rules
from claritable.functions import text

_NUMBER = r"^\s*(?:[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)\s*$"

_TIME = r"((?:[T ]\s*\d{1,2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?\s*(?:Z|UTC|[+-]\d{2}:?\d{2})?)?)\s*$"
_SEP = r"[-/.]"
_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec"
_MONTH_NAME = (r"(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?"
               r"|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)")

_ISO = r"^\s*\d{4}-\d{1,2}-\d{1,2}(?!\d)"
_YEAR_FIRST = rf"^\s*(\d{{4}}){_SEP}(\d{{1,2}}){_SEP}(\d{{1,2}}){_TIME}"
_YEAR_LAST = rf"^\s*\d{{1,2}}{_SEP}\d{{1,2}}{_SEP}\d{{2}}(?:\d{{2}})?(?!\d)"
_NAMED = rf"(?i)({_MONTH_NAME})"
_COMPACT = r"^\s*(\d{4})(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])\s*$"

# Everyday forms that are brought to one of the others first: half-day clocks, weekday names, compact
# dates with a time, and a month without a day (its first day).
_HALF_DAY = r"(?i)^(.*?[ T,])\s*(0?[1-9]|1[0-2])(:\d{2}(?::\d{2})?)\s*([ap])\.?m\.?\s*$"
_WEEKDAY = r"(?i)^\s*(?:mon|tues?|wed(?:nes)?|thu(?:rs?)?|fri|sat(?:ur)?|sun)(?:day)?[.,]*\s+(?=\S)"
_COMPACT_TIME = r"^\s*(\d{4})(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])[T ](\d{2})(\d{2})(\d{2})(Z?)\s*$"
_MONTH = r"^\s*((?:19|20)\d{2})-(0[1-9]|1[0-2])\s*$"
_EVERYDAY = r"(?i)[ap]\.?m\.?\s*$|^\s*[mtwfs][a-z]{2,8}[.,]*\s|^\s*\d{8}[T ]\d{6}Z?\s*$|^\s*\d{4}-\d{2}\s*$"

# The usual forms, which need one step at most: as Spark reads it, with other separators, and month first.
_USUAL_ISO = r"^\d{4}-\d{1,2}-\d{1,2}(?:[T ][\d:.Z+-]*)?\z"
_USUAL_YEAR_FIRST = r"^\d{4}[/.]\d{1,2}[/.]\d{1,2}\z"
_USUAL_MONTH_FIRST = rf"^(0?[1-9]|1[0-2]){_SEP}(\d{{1,2}}){_SEP}(\d{{4}})\z"


# Letters the double parser would read as a suffix, an infinity, a NaN or a hex digit.
_NOT_DECIMAL = "dDfFiInNxXpP"


def _parse(c: Column) -> Column:
    return c.try_cast("double")


def _ends_like_number(c: Column) -> Column:
    """True for every text that reads as a number: none ends in a letter. What is spared is the exception of a failed cast."""
    return F.substring(c.cast("binary"), -1, 1) <= F.lit(b"9")


def number(c: Column) -> Column:
    """A number with ``, $ %`` removed and ``(x)`` read as ``-x``."""
    bare = F.translate(c, _NOT_DECIMAL + ",$%", "#" * len(_NOT_DECIMAL))
    return _parse(F.when(~_ends_like_number(c), None)
                  .when(F.contains(c, F.lit("(")), F.regexp_replace(bare, r"\(([^)]+)\)", "-$1"))
                  .otherwise(bare))


def plain_number(c: Column) -> Column:
    """A number as written, without removing currency signs or separators."""
    return _parse(F.when(_ends_like_number(c), F.translate(c, _NOT_DECIMAL, "#" * len(_NOT_DECIMAL))))


def looks_numeric(c: Column) -> Column:
    return F.translate(c, ",$", "").rlike(_NUMBER)


def number_to_text(n: Column) -> Column:
    """Shortest plain text of a double: ``900``, ``1200.5``, ``12345678901``."""
    # Of the doubles that are written plainly only zero ends in ".0".
    plain = F.when(n == 0, F.regexp_replace(n.cast("string"), r"\.0$", "")).otherwise(n.cast("string"))
    wide = F.regexp_replace(n.try_cast("decimal(38,10)").cast("string"), r"\.?0+$", "")
    whole = (F.abs(n) < 1e7) & (n == F.rint(n)) & (n != 0)
    return (F.when(whole, n.cast("bigint").cast("string"))
            .when(F.abs(n).between(1e7, 1e27), wide).otherwise(plain))


def boolean(c: Column) -> Column:
    return F.when(text.is_token(c, rules.TRUE_TOKENS), F.lit(True)).when(
        text.is_token(c, rules.FALSE_TOKENS), F.lit(False))


def looks_boolean(c: Column) -> Column:
    return text.is_token(c, rules.TRUE_TOKENS + rules.FALSE_TOKENS)


def _two_digits_from(low: int) -> str | None:
    """Pattern of the two-digit numbers ``low`` to 99."""
    if low > 99:
        return None
    tens, ones = divmod(max(low, 0), 10)
    parts = [f"{tens}[{ones}-9]"]
    if tens < 9:
        parts.append(rf"[{tens + 1}-9]\d")
    return "(?:" + "|".join(parts) + ")"


def _four_digit_year(c: Column, head: str, as_of: dt.date) -> Column:
    """Widen ``head`` + two-digit year to the century within 50 years of ``as_of``."""
    century = as_of.year // 100
    older = _two_digits_from(as_of.year % 100 + 50)
    if older:
        c = F.regexp_replace(c, rf"(?i)^({head})({older})(?!\d)", f"$1{century - 1}$2")
    return F.regexp_replace(c, rf"(?i)^({head})(\d\d)(?!\d)", f"$1{century}$2")


def timestamp(c: Column, as_of: dt.date) -> Column:
    """Mixed-format timestamp; offsets are applied, so use a UTC session time zone.

    Year first, month first (day first when the month cannot be one), month names and
    ``yyyyMMdd``, each with an optional time and offset, a weekday before it or a clock of
    half days.  ``yyyy-MM`` is the first of its month; bare years, postal codes and clock
    times are not dates.
    """
    # The first three settle most dates by one look and one step; what has no digit is no date.
    canonical = (
        F.when(c.rlike(_USUAL_ISO), c)
        .when(c.rlike(_USUAL_MONTH_FIRST), F.regexp_replace(c, _USUAL_MONTH_FIRST, "$3-$1-$2"))
        .when(c.rlike(_USUAL_YEAR_FIRST), F.translate(c, "/.", "--"))
        .when(c.rlike(r"\d"), _once(F.when(c.rlike(_EVERYDAY), _plain(c)).otherwise(c), lambda x: _canonical(x, as_of)))
    )
    return canonical.try_cast("timestamp")


def _once(c: Column, read: Callable[[Column], Column]) -> Column:
    """``read(c)`` with ``c`` computed once: copies of a long expression would outgrow what Spark compiles."""
    return F.transform(F.array(c), read)[0]


def _canonical(c: Column, as_of: dt.date) -> Column:
    """Any of the forms but the everyday ones with its year first; NULL for other text."""
    numeric = _four_digit_year(c, rf"\s*\d{{1,2}}{_SEP}\d{{1,2}}{_SEP}", as_of)
    numeric = F.regexp_replace(
        numeric, rf"^\s*(1[3-9]|2\d|3[01]){_SEP}(\d{{1,2}}){_SEP}(\d{{4}}){_TIME}", "$3-$2-$1$4")
    numeric = F.regexp_replace(
        numeric, rf"^\s*(\d{{1,2}}){_SEP}(\d{{1,2}}){_SEP}(\d{{4}}){_TIME}", "$3-$1-$2$4")

    # "Feb 3, 2024" is brought to "3-Feb-2024" first.
    named = F.regexp_replace(
        c, rf"(?i)^\s*({_MONTH_NAME})\.?[- ]+(\d{{1,2}})(?:st|nd|rd|th)?,?[- ]+(\d{{4}}|\d\d)(?!\d)",
        "$2-$1-$3")
    named = _four_digit_year(named, rf"\s*\d{{1,2}}[- ]{_MONTH_NAME}\.?[-, ]+", as_of)
    named = F.regexp_replace(
        named, rf"(?i)^\s*(\d{{1,2}})[- ]{_MONTH_NAME}\.?[-, ]+(\d{{4}}){_TIME}", "$2-#-$1$3")
    named = F.replace(named, F.lit("#"), _month_number(c))

    return (
        F.when(c.rlike(_ISO), c)
        .when(c.rlike(_YEAR_LAST), numeric)
        .when(c.rlike(_YEAR_FIRST), F.regexp_replace(c, _YEAR_FIRST, "$1-$2-$3$4"))
        .when(c.rlike(_NAMED), named)
        .when(c.rlike(_COMPACT), F.regexp_replace(c, _COMPACT, "$1-$2-$3"))
    )


def _plain(c: Column) -> Column:
    """Everyday forms without weekday and half-day clock, and with all parts apart."""
    return _once(F.regexp_replace(c, _WEEKDAY, ""), _plain_day)


def _plain_day(day: Column) -> Column:
    part = lambda k: F.regexp_extract(day, _HALF_DAY, k)
    hour = part(2).cast("int") % 12 + F.when(F.lower(part(4)) == "p", 12).otherwise(0)
    return (F.when(day.rlike(_HALF_DAY), F.concat(
                F.regexp_replace(part(1), r"[ T,]+$", ""), F.lit(" "), F.lpad(hour.cast("string"), 2, "0"), part(3)))
            .when(day.rlike(_COMPACT_TIME), F.regexp_replace(day, _COMPACT_TIME, "$1-$2-$3 $4:$5:$6$7"))
            .when(day.rlike(_MONTH), F.regexp_replace(day, _MONTH, "$1-$2-01"))
            .otherwise(day))


def _month_number(c: Column) -> Column:
    name = F.lower(F.left(F.regexp_extract(c, _NAMED, 1), F.lit(3)))
    return F.floor((F.position(name, F.lit(_MONTHS)) + 3) / 4).cast("string")


_DATE_START = (r"(?i)^\s*(?:\d|mon|tue|wed|thu|fri|sat|sun|" + _MONTHS.replace(" ", "|") + ")")
_NOT_NUMERIC = r"(?U)[^\s\x00-\x20\d.,$+\-eE]"


def may_be_date(c: Column) -> Column:
    """Cheap test that every text with a :func:`timestamp` passes: all forms start with a digit, month or weekday."""
    return c.rlike(_DATE_START)


def may_be_number(c: Column) -> Column:
    """Cheap test that every number and postal code passes: no letter but of an exponent, and no other sign."""
    return ~c.rlike(_NOT_NUMERIC)


def date(c: Column, as_of: dt.date) -> Column:
    return timestamp(c, as_of).cast("date")


def date_to_text(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM-dd")
