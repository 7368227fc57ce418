"""Exact duplicates over whole rows.

Both operators are plain hash aggregates: copies are merged inside each map task first,
so a row repeated a billion times sends one record per task to its reducer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claritable.operators.cells import DATASET


def _quoted(names: list[str]) -> list[Column]:
    return [F.col(f"`{name}`") for name in names]


def drop_duplicates(df: DataFrame, keep_first: str | None = None) -> DataFrame:
    """Distinct rows.

    ``keep_first`` names a row key: rows then compare on the other columns and the copy
    with the smallest key stays.
    """
    if keep_first is None:
        return df.dropDuplicates()
    compared = [c for c in df.columns if c != keep_first]
    return df.groupBy(*_quoted(compared)).agg(F.min(keep_first).alias(keep_first)).select(
        *_quoted(df.columns))


def duplicate_rate(df: DataFrame, *, columns: list[str] | None = None,
                   group: str | None = None) -> DataFrame:
    """Rows, repeated rows and their share; per value of ``group`` when one is named."""
    columns = columns or [c for c in df.columns if c != group]
    by = [F.col(group).alias(DATASET)] if group else []
    copies = df.groupBy(*by, *_quoted(columns)).agg(F.count(F.lit(1)).alias("_copies"))
    rows = F.coalesce(F.sum("_copies"), F.lit(0))
    repeated = rows - F.count(F.lit(1))
    return copies.groupBy(*([DATASET] if group else [])).agg(
        rows.alias("row_count"), repeated.alias("duplicate_rows"),
        F.when(rows > 0, repeated / rows).otherwise(F.lit(0.0)).alias("duplicate_rate"))
