"""De-identification: which rule a column falls under, and the rule as an expression."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claritable import rules
from claritable.functions import coerce, names, pii, text

MASKED = "columns_masked"
TRUNCATED = "zip_truncated"
GENERALIZED = "dates_generalized"


def safe_harbor_rule(name: str, hint: str | None) -> tuple[str, str | None] | None:
    """``(transform, label)`` for a column, first rule wins; None when it stays."""
    for _, tokens, label in rules.SAFE_HARBOR:
        if names.has_token(name, tokens):
            return MASKED, label
    if names.has_token(name, rules.SAFE_HARBOR_ZIP):
        return TRUNCATED, None
    if hint in rules.SAFE_HARBOR_DATE_HINTS or names.contains_any(name, rules.SAFE_HARBOR_DATE_TOKENS):
        return GENERALIZED, None
    return None


def is_birth_date(name: str, hint: str | None) -> bool:
    return hint == "dob" or names.contains_any(name, ("dob", "birth"))


def holds_names(name: str) -> bool:
    return "name" in name and "username" not in name


def cell_text(c: Column, kind: T.DataType) -> Column:
    """A typed cell as the text it would be written as."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return coerce.number_to_text(c.cast("double"))
    if isinstance(kind, T.DateType):
        return coerce.date_to_text(c)
    return c.cast("string")


def generalize_date(c: Column, kind: T.DataType, *, birth: bool, as_of: dt.date) -> Column:
    """Year of a date; birth years more than 89 years back become ``90+``."""
    parsed = c if isinstance(kind, (T.DateType, T.TimestampType)) else coerce.timestamp(c, as_of)
    year = F.year(parsed)
    out = year.cast("string")
    if birth:
        out = F.when(F.lit(as_of.year) - year > rules.OLDEST_AGE, F.lit(rules.OLDEST_LABEL)).otherwise(out)
    return F.when(c.isNull(), F.lit(None).cast("string")).otherwise(
        F.coalesce(out, F.lit(rules.REDACTED_DATE)))


def redact_columns(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Free-text redaction of every column; name columns are replaced where not null."""
    return df.select(*[_redacted(df, c).alias(c) if c not in keep else F.col(c) for c in df.columns])


def _redacted(df: DataFrame, name: str) -> Column:
    c, kind = F.col(f"`{name}`"), df.schema[name].dataType
    if holds_names(name):
        return pii.redact_name(c)
    if isinstance(kind, (T.DateType, T.BooleanType)):
        return cell_text(c, kind)
    return pii.redact(cell_text(c, kind))


def _harbored(c: Column, kind: T.DataType, name: str, hint: str | None, as_of: dt.date) -> Column:
    rule = safe_harbor_rule(name, hint)
    if rule is None:
        return c
    transform, label = rule
    if transform == MASKED:
        return F.lit(label)
    if transform == TRUNCATED:
        return text.zip3(cell_text(c, kind))
    return generalize_date(c, kind, birth=is_birth_date(name, hint), as_of=as_of)


def safe_harbor(df: DataFrame, hints: dict[str, str | None], as_of: dt.date,
                keep: tuple[str, ...] = ()) -> DataFrame:
    """Column masks, ZIP3 and year-only dates.  A mask covers every row, nulls too."""
    return df.select(*[
        F.col(c) if c in keep
        else _harbored(F.col(f"`{c}`"), df.schema[c].dataType, c, hints.get(c), as_of).alias(c)
        for c in df.columns])


def deidentify(df: DataFrame, hints: dict[str, str | None], as_of: dt.date, *, redact: bool,
               harbor: bool, keep: tuple[str, ...] = ()) -> DataFrame:
    """Redaction, then Safe Harbor, in one projection."""
    if not (redact or harbor):
        return df
    out = []
    for name in df.columns:
        c, kind, hint = F.col(f"`{name}`"), df.schema[name].dataType, hints.get(name)
        if name in keep:
            out.append(c)
            continue
        rule = safe_harbor_rule(name, hint) if harbor else None
        dated = rule is not None and rule[0] == GENERALIZED and isinstance(kind, T.DateType)
        if redact and not dated:
            c, kind = _redacted(df, name), T.StringType()
        out.append((_harbored(c, kind, name, hint, as_of) if harbor else c).alias(name))
    return df.select(*out)


def privacy_report(columns: DataFrame) -> DataFrame:
    """``(column_name, transform)`` over a table of column names and hints."""
    name, hint = F.col("clean_name"), F.col("semantic_hint")
    masked = F.lit(False)
    for _, tokens, _ in rules.SAFE_HARBOR:
        masked = masked | names.any_whole_token(name, tokens)
    dated = (F.coalesce(hint.isin(*rules.SAFE_HARBOR_DATE_HINTS), F.lit(False))
             | names.any_token(name, rules.SAFE_HARBOR_DATE_TOKENS))
    transform = (
        F.when(masked, F.lit(MASKED))
        .when(names.any_whole_token(name, rules.SAFE_HARBOR_ZIP), F.lit(TRUNCATED))
        .when(dated, F.lit(GENERALIZED))
    )
    return columns.withColumn("transform", transform).filter(F.col("transform").isNotNull())
