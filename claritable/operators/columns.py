"""Operators over a table of columns: one row per dataset and column of a catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claritable import rules
from claritable.functions import names
from claritable.operators.cells import DATASET


def standardize_columns(df: DataFrame) -> DataFrame:
    """The table with clean, unique column names."""
    return df.toDF(*names.standardize(df.columns))


def standardize_catalog(columns: DataFrame, name: str = "name", position: str = "position") -> DataFrame:
    """Clean, unique names for every dataset of a catalog.

    A group is the column list of one table, so its size is the table's width.
    """
    listed = columns.groupBy(DATASET).agg(
        F.array_sort(F.collect_list(F.struct(
            F.col(position).alias("position"), F.col(name).alias("original"),
            names.snake_case_expr(F.col(name)).alias("base")))).alias("cols"))

    def place(taken: Column, c: Column) -> Column:
        numbered = F.transform(F.sequence(F.lit(2), F.size(taken) + 2),
                               lambda i: F.concat(c["base"], F.lit("_"), i.cast("string")))
        free = F.filter(numbered, lambda x: ~F.array_contains(taken, x))
        return F.array_append(taken, F.when(F.array_contains(taken, c["base"]), free[0])
                              .otherwise(c["base"]))

    clean = F.aggregate("cols", F.array().cast("array<string>"), place)
    return listed.withColumn("clean", clean).select(
        DATASET, F.inline(F.arrays_zip("cols", "clean"))).select(
        DATASET, F.col("cols.position").alias("position"),
        F.col("cols.original").alias("original_name"), F.col("clean").alias("clean_name"))


def column_roles(columns: DataFrame, name: str = "clean_name") -> DataFrame:
    """Which columns look like PII, must not be dropped, or may hold open text."""
    c = F.col(name)
    return columns.withColumns({
        "is_pii": names.any_token(c, rules.PII_COLUMN_TOKENS),
        "is_protected": names.any_token(c, rules.PROTECTED_NAME_TOKENS),
        "is_open_text": ~names.any_token(c, rules.NON_TEXT_NAME_TOKENS),
    })


def name_hints(columns: DataFrame, name: str = "clean_name") -> DataFrame:
    """Hint, cleaner fallback hint and domain tags read from the names alone."""
    c = F.col(name)
    return columns.withColumns({
        "semantic_hint": names.hint_expr(c), "fallback_hint": names.fallback_hint_expr(c),
        "domain_tags": names.tags_expr(c)})
