"""The long form of a table: one row per cell, the shape all per-column metrics share.

A wide table has tens of columns times a dozen measures.  Unpivoting first keeps every
measure a single expression keyed by ``column_name`` instead of hundreds of aggregate
functions over one row, and all columns are read in the same scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claritable.functions.coerce import number_to_text

DATASET = "dataset_id"
COLUMN = "column_name"
VALUE = "value"
ROW = "_row"


def dataset_column(dataset: str | Column) -> Column:
    """A name for one table, or a column that tells many tables apart."""
    return F.lit(dataset) if isinstance(dataset, str) else dataset


def as_text(df: DataFrame, name: str) -> Column:
    """The cell as text; nested values become JSON."""
    kind = df.schema[name].dataType
    cell = F.col(f"`{name}`")
    if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        return F.to_json(cell)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return number_to_text(cell.cast("double"))
    return cell.cast("string")


def row_key(order_by: str | Column | None) -> Column:
    """Order key of a row; the scan order when none is named."""
    if order_by is None:
        return F.monotonically_increasing_id()
    return F.col(order_by) if isinstance(order_by, str) else order_by


def keys_of(dataset: str | Column) -> list[str]:
    """Grouping keys; a single named table needs no dataset key in its shuffles."""
    return [COLUMN] if isinstance(dataset, str) else [DATASET, COLUMN]


def cells(df: DataFrame, columns: dict[str, str], *, dataset: str | Column = "dataset",
          order_by: str | Column | None = None, with_row: bool = True) -> DataFrame:
    """``([dataset_id], [_row], column_name, value)`` for the given ``{source: label}`` columns."""
    ids = []
    if not isinstance(dataset, str):
        ids.append(dataset.alias(DATASET))
    if with_row:
        ids.append(row_key(order_by).alias(ROW))
    # The ids travel inside the cell: plans built twice over one table then have equal
    # unpivots, and their shuffles are shared.
    wide = df.select(*[F.struct(*ids, _nullable_text(df, source).alias(VALUE)).alias(label)
                       for source, label in columns.items()])
    long = wide.unpivot([], [f"`{label}`" for label in columns.values()], COLUMN, "cell")
    return long.select(COLUMN, "cell.*")


def with_dataset(df: DataFrame, dataset: str | Column) -> DataFrame:
    return df.withColumn(DATASET, F.lit(dataset)) if isinstance(dataset, str) else df


def _nullable_text(df: DataFrame, name: str) -> Column:
    # All cells must agree that a value may be null, masks included.
    cell = as_text(df, name)
    return cell if df.schema[name].nullable else F.nullif(cell, F.lit("\x00"))


def label_map(values: dict[str, object]) -> Column:
    """Literal map, for looking up what is known about each column by its name."""
    pairs = [F.lit(item) for pair in values.items() for item in pair]
    return F.create_map(*pairs)
