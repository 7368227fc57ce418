"""Column builders for missing values, whitespace, case and healthcare value formats.

Each builder evaluates its input once per row and stays inside generated code, so a
whole table is rewritten by a single projection.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from claritable import rules

# (?U) gives \s, \d and \b the Unicode meaning they have in most languages.
_SPACES = r"(?U)\s+"
_EDGES = r"(?U)^\s+|\s+$"
_LETTER_RUNS = r"\p{L}+|[^\p{L}]+"
# Words of printable ASCII with one space between them: nothing to collapse or to trim.
_TIDY = r"^[!-~]++(?: [!-~]++)*+\z"
# Anything but printable ASCII and spaces.
_ODD = r"[^ -~]"


def _starts_printable(c: Column) -> Column:
    """True where the first character is printable ASCII; texts compare by their bytes."""
    return (c >= F.lit("!")) & (c < F.lit("\x7f"))


def _bare(c: Column) -> Column:
    """True where the first and the last character are printable ASCII, so that trimming changes nothing."""
    last = F.substring(c.cast("binary"), -1, 1)
    return _starts_printable(c) & (last >= F.lit(b"!")) & (last < F.lit(b"\x7f"))


def has_text(c: Column) -> Column:
    """True where some character is no space."""
    return _starts_printable(c) | c.rlike(r"(?U)\S")


def is_token(c: Column, tokens: Iterable[str]) -> Column:
    """True where ``c``, trimmed and in lower case, is one of the tokens.

    Most cells have printable edges and are settled by their length, or by comparing a short string.
    """
    tokens = list(tokens)
    longest = max(map(len, tokens))
    # A character has up to four bytes; the lengths keep long cells from being copied.
    short = (F.octet_length(c) <= 4 * longest) & (F.length(c) <= longest)
    return F.when(_bare(c), short & F.lower(c).isin(tokens)).otherwise(_is_padded(c, tokens))


def _is_padded(c: Column, tokens: list[str]) -> Column:
    """:func:`is_token` for any cell.

    The pattern, which also knows tabs, line breaks and Unicode spaces, only sees cells with an unusual edge.
    """
    trimmed = F.trim(c)
    plain = (F.length(trimmed) <= max(map(len, tokens))) & F.lower(trimmed).isin(tokens)
    printable = lambda ch: F.ascii(ch).between(33, 126)
    unusual = ~printable(trimmed) | ~printable(F.substring(trimmed, -1, 1))
    choices = "|".join(re.escape(t) for t in tokens if t)
    pattern = rf"(?iU)^\s*(?:{choices}){'?' if '' in tokens else ''}\s*$"
    return plain | (unusual & c.rlike(pattern))


def is_missing_token(c: Column) -> Column:
    """True for a non-null value that stands for "no value"."""
    return is_token(c, rules.MISSING_TOKENS)


def is_missing(c: Column) -> Column:
    return c.isNull() | is_missing_token(c)


def normalize_missing(c: Column) -> Column:
    """Missing tokens become NULL; every other value is left as it is."""
    return F.when(~is_missing_token(c), c)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, _EDGES, "")


def collapse(c: Column) -> Column:
    """Whitespace runs become one space, edges are trimmed."""
    # Plain text with single spaces, the common case, is recognised by one look.
    spaces = F.when(c.rlike(_ODD), F.regexp_replace(c, _SPACES, " ")).otherwise(F.regexp_replace(c, "  +", " "))
    return F.when(c.rlike(_TIDY), c).otherwise(F.trim(spaces))


def title_case(c: Column) -> Column:
    """Capitalise every run of letters: ``o'neil-smith`` becomes ``O'Neil-Smith``."""
    runs = F.regexp_extract_all(c, F.lit(_LETTER_RUNS), F.lit(0))
    return F.array_join(
        F.transform(runs, lambda run: F.concat(F.upper(F.left(run, F.lit(1))),
                                               F.lower(F.substr(run, F.lit(2))))), "")


def text_case(c: Column, case: str) -> Column:
    if case == "lower":
        return F.lower(c)
    if case == "upper":
        return F.upper(c)
    if case == "title":
        return title_case(c)
    return c


def first_match(c: Column, pattern: str) -> Column:
    """First group of ``pattern`` in ``c``, NULL where it does not match."""
    return F.try_element_at(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), F.lit(1))


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\D+", "")


def _filled(c: Column) -> Column:
    return F.when(c != "", c)


def normalize_phone(c: Column) -> Column:
    return _filled(F.right(digits(c), F.lit(10)))


def normalize_postal(c: Column) -> Column:
    return _filled(F.left(digits(c), F.lit(5)))


def normalize_ndc(c: Column) -> Column:
    d = digits(c)
    return F.when(F.length(d) == 10, F.concat(F.lit("0"), d)).otherwise(_filled(d))


def normalize_rxnorm(c: Column) -> Column:
    return _filled(digits(c))


def compact_code(c: Column) -> Column:
    return F.upper(F.replace(c, F.lit(" "), F.lit("")))


def normalize_gender(c: Column) -> Column:
    """Known spellings become M, F, O or U; anything else is kept."""
    by_label: dict[str, list[str]] = {}
    for spelling, label in rules.GENDER_VALUES.items():
        by_label.setdefault(label, []).append(spelling)
    labels = F.create_map(*[F.lit(x) for pair in rules.GENDER_VALUES.items() for x in pair])
    chain = F.when(_bare(c), F.coalesce(labels[F.lower(c)], c))
    for label, spellings in by_label.items():
        chain = chain.when(_is_padded(c, spellings), F.lit(label))
    return chain.otherwise(c)


def zip3(c: Column) -> Column:
    """First three digits and ``00``; NULL when there are fewer than three."""
    return F.concat(first_match(digits(c), r"^(\d{3})"), F.lit("00"))
