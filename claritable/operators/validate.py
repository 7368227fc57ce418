"""Validation rules: every rule of every column is counted in one aggregation."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claritable import rules
from claritable.functions import coerce, names
from claritable.operators.cells import COLUMN, DATASET

_TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)


def violations(c: Column, pattern: str) -> Column:
    """Non-null values that do not match."""
    return c.isNotNull() & ~c.cast("string").rlike(pattern)


def _moment(df: DataFrame, name: str, as_of: dt.date) -> Column:
    c = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, _TEMPORAL):
        return c.cast("timestamp")
    return coerce.timestamp(c.cast("string"), as_of)


def _midnight(day: dt.date) -> Column:
    """Start of a day in UTC, whatever the time zone of the driver."""
    return F.lit(f"{day.isoformat()} 00:00:00+00:00").cast("timestamp")


def _amount(df: DataFrame, name: str) -> Column:
    c = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, T.NumericType):
        return c.cast("double")
    return coerce.plain_number(c.cast("string"))


def rules_for(df: DataFrame, name: str, hint: str | None, as_of: dt.date) -> list[tuple]:
    """``(issue_type, message, failing rows)`` of the rules this column falls under."""
    lower = name.lower()
    found = []
    if hint == "dob" or names.contains_any(lower, ("dob", "birth")):
        found.append(("dob_future", "DOB values in the future",
                      _moment(df, name, as_of) > _midnight(as_of)))
    if hint in rules.FUTURE_DATE_HINTS or "date" in lower:
        limit = _midnight(as_of + dt.timedelta(days=1))
        found.append(("date_future", "Dates in the future", _moment(df, name, as_of) > limit))
    for issue, token, pattern, message in rules.CODE_RULES:
        if token in lower:
            found.append((issue, message, violations(F.col(f"`{name}`"), pattern)))
    if names.contains_any(lower, rules.AMOUNT_TOKENS):
        found.append(("negative_amount", "Negative monetary values", _amount(df, name) < 0))
    return found


def rule_counts(df: DataFrame, hints: dict[str, str | None], as_of: dt.date, *,
                dataset: str | Column = "dataset", exclude: tuple[str, ...] = (),
                only: tuple[str, ...] | None = None) -> DataFrame:
    """One row per (dataset, rule, column), zero counts included."""
    checks = []
    for name in df.columns:
        if name in exclude:
            continue
        for issue, message, failing in rules_for(df, name, hints.get(name), as_of):
            if only is None or issue in only:
                checks.append((name, issue, message, failing))
    named = isinstance(dataset, str)
    grouped = df.groupBy() if named else df.groupBy(dataset.alias(DATASET))
    totals = grouped.agg(F.count(F.lit(1)).alias("row_count"),
                         *[F.count_if(failing).alias(f"r{i}") for i, (_, _, _, failing) in enumerate(checks)])
    order = list(rules.ISSUE_WEIGHTS)
    entries = [F.struct(F.lit(order.index(issue)).alias("rule_order"),
                        F.lit(issue).alias("issue_type"), F.lit(name).alias(COLUMN),
                        F.lit(message).alias("message"), F.col(f"r{i}").alias("count"))
               for i, (name, issue, message, _) in enumerate(checks)]
    if not entries:
        empty = ("rule_order int, issue_type string, column_name string, message string, count bigint")
        rows = F.inline(F.from_json(F.lit("[]"), f"array<struct<{empty.replace(' ', ':').replace(',:', ',')}>>"))
    else:
        rows = F.inline(F.array(*entries))
    key = F.lit(dataset).alias(DATASET) if named else F.col(DATASET)
    return totals.select(key, "row_count", rows)


def with_severity(counts: DataFrame) -> DataFrame:
    """Severity of each count from its rate and the weight of its rule."""
    issue = F.col("issue_type")
    weight = F.coalesce(F.create_map(*[F.lit(x) for kv in rules.ISSUE_WEIGHTS.items() for x in kv])[issue],
                        F.lit(1.0))
    rate = F.col("count") / F.greatest(F.col("row_count"), F.lit(1)) * 100.0
    critical = issue.isin(*rules.ALWAYS_HIGH) & (F.col("count") > 0)
    level = (F.when(critical | (F.col("_score") >= rules.SEVERITY_HIGH), "high")
             .when(F.col("_score") >= rules.SEVERITY_MEDIUM, "medium").otherwise("low"))
    reasons = rules.SEVERITY_REASONS
    reason = F.when(critical, F.lit(reasons["critical"]))
    for name in ("high", "medium", "low"):
        reason = reason.when(F.col("severity") == name, F.lit(reasons[name]))
    return (
        counts.withColumns({"_rate": rate, "impact_weight": weight})
        .withColumn("_score", F.col("_rate") * F.col("impact_weight"))
        .withColumn("severity", level)
        .withColumns({"rate_pct": F.bround("_rate", 3), "severity_score": F.bround("_score", 3),
                      "reason": reason})
        .drop("_rate", "_score")
    )


def issues(df: DataFrame, hints: dict[str, str | None], as_of: dt.date, **options) -> DataFrame:
    """The issue table: one row per rule and column that failed at least once."""
    return with_severity(rule_counts(df, hints, as_of, **options).filter(F.col("count") > 0))


# --- summaries --------------------------------------------------------------
def severity_rank(severity: Column) -> Column:
    return F.when(severity == "high", 3).when(severity == "medium", 2).otherwise(1)


def severity_counts(issue_rows: DataFrame) -> DataFrame:
    severity = F.col("severity")
    return issue_rows.groupBy(DATASET).agg(
        F.count_if(severity == "high").alias("high"), F.count_if(severity == "medium").alias("medium"),
        F.count_if(~severity.isin("high", "medium") | severity.isNull()).alias("low"),
        F.count(F.lit(1)).alias("total"))


def top_issues(issue_rows: DataFrame, limit: int = 5) -> DataFrame:
    """Worst issues per dataset, by severity, score and count."""
    order = W.partitionBy(DATASET).orderBy(
        severity_rank(F.col("severity")).desc(), F.desc("severity_score"), F.desc("count"),
        "rule_order", COLUMN)
    return issue_rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
