"""Personal-data detectors and free-text redaction as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claritable import rules
from claritable.functions import text

EMAIL = rules.EMAIL
PHONE = "(?U)" + rules.PHONE
SSN = "(?U)" + rules.SSN


# What every phone and SSN holds; one search spares most text the two patterns.
_DIGITS = r"(?U)\d{3}[-.\s]?\d{2}"
# Phones and SSNs but for their word edges, which cost more to tell than their digits.
_NUMBERS = r"(?U)\d{3}[-.\s]?(?:\d{3}[-.\s]?\d{4}|\d{2}-?\d{4})"
# Bytes of the shortest of each.
_PHONE_BYTES, _SSN_BYTES = 10, 9


def has_email(c: Column) -> Column:
    # The byte search for "@" spares most cells the pattern.
    return F.contains(c, F.lit("@")) & c.rlike(EMAIL)


def may_have_number(c: Column) -> Column:
    """Test that every text with a phone or an SSN passes, for those who look for both."""
    return (F.octet_length(c) >= _SSN_BYTES) & c.rlike(_NUMBERS)


def has_phone(c: Column) -> Column:
    return (F.octet_length(c) >= _PHONE_BYTES) & c.rlike(_DIGITS) & c.rlike(PHONE)


def has_ssn(c: Column) -> Column:
    return (F.octet_length(c) >= _SSN_BYTES) & c.rlike(_DIGITS) & c.rlike(SSN)


def is_zip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "").rlike(rules.ZIP_VALUE)


def redact(c: Column) -> Column:
    """Mask emails, then phones, then SSNs inside free text."""
    def numbers(text_: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(text_, PHONE, rules.REDACTED_PHONE),
                                SSN, rules.REDACTED_SSN)

    # The label of an email holds no digits, so the digit search on the input stays valid.
    some_digits = c.rlike(_DIGITS)
    mail = F.regexp_replace(c, EMAIL, rules.REDACTED_EMAIL)
    return (F.when(F.contains(c, F.lit("@")), F.when(some_digits, numbers(mail)).otherwise(mail))
            .when(some_digits, numbers(c)).otherwise(c))


def redact_name(c: Column) -> Column:
    return F.when(c.isNotNull(), F.lit(rules.REDACTED_NAME))


def retrieval_text(c: Column) -> Column:
    """Redacted text on one line, for retrieval indexes."""
    return text.collapse(redact(text.strip(c)))
