"""Before/after quality reports as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claritable import rules
from claritable.functions import names, pii, text
from claritable.functions.scoring import percent
from claritable.operators.cells import COLUMN, DATASET, VALUE, as_text, cells, keys_of, with_dataset
from claritable.sources.scratch import materialize

_TEXT = (T.StringType, T.ArrayType, T.StructType, T.MapType)
#: Types whose cells are missing by their text, or have no text that is a missing token.
_SAME_TEXT = (*_TEXT, T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def is_text(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, _TEXT)


def _in_columns(names_: list[str]) -> Column:
    return F.col(COLUMN).isin(*names_) if names_ else F.lit(False)


def missing_percent(df: DataFrame, *, dataset: str | Column = "dataset",
                    exclude: tuple[str, ...] = ()) -> DataFrame:
    """Missing cells per column; missing tokens count in text columns."""
    columns = {c: c for c in df.columns if c not in exclude}
    texts = [c for c in columns if is_text(df, c)]
    if isinstance(dataset, str):
        # One table: a count for each column of the one scan, without a row for every cell.
        gone = {c: F.col(f"`{c}`").isNull() for c in columns}
        for c in texts:
            gone[c] = gone[c] | text.is_missing_token(as_text(df, c))
        totals = df.agg(F.count(F.lit(1)).alias("row_count"),
                        *[F.count_if(flag).alias(f"m{i}") for i, flag in enumerate(gone.values())])
        entries = [F.struct(F.lit(c).alias(COLUMN), F.col(f"m{i}").alias("missing")) for i, c in enumerate(gone)]
        rows = totals.select(F.lit(dataset).alias(DATASET), "row_count", F.inline(F.array(*entries)))
        return rows.select(DATASET, COLUMN, "row_count", "missing", percent(
            F.col("missing"), F.col("row_count")).alias("missing_pct"))
    value = F.col(VALUE)
    missing = value.isNull() | (_in_columns(texts) & text.is_missing_token(value))
    counted = cells(df, columns, dataset=dataset, with_row=False).groupBy(*keys_of(dataset)).agg(
        F.count(F.lit(1)).alias("row_count"), F.count_if(missing).alias("missing"))
    return with_dataset(counted, dataset).withColumn(
        "missing_pct", percent(F.col("missing"), F.col("row_count")))


def column_metrics(df: DataFrame, *, dataset: str | Column = "dataset",
                   exclude: tuple[str, ...] = ()) -> DataFrame:
    """Everything the readiness checks need to know about each column, in one scan."""
    columns = {c: c for c in df.columns if c not in exclude}
    texts = [c for c in columns if is_text(df, c)]
    scanned = [c for c in texts if not names.contains_any(c, rules.PII_NAME_TOKENS)]
    value, textual, open_text = F.col(VALUE), _in_columns(texts), _in_columns(scanned)
    missing = value.isNull() | (textual & text.is_missing_token(value))
    # The look for digits is a column, which both counts read.
    digits = F.col("_digits")
    looked = cells(df, columns, dataset=dataset, with_row=False).withColumn(
        "_digits", open_text & pii.may_have_number(value))
    counted = looked.groupBy(*keys_of(dataset)).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count(value).alias("non_null"),
        F.count_if(missing).alias("missing"),
        F.count_if(textual & text.has_text(value)).alias("non_blank"),
        F.sum(F.when(textual, F.length(value))).alias("total_length"),
        F.count_if(open_text & pii.has_email(value)).alias("pii_email"),
        F.count_if(digits & value.rlike(pii.PHONE)).alias("pii_phone"),
        F.count_if(digits & value.rlike(pii.SSN)).alias("pii_ssn"),
    )
    position = F.array_position(F.array(*[F.lit(c) for c in columns]), F.col(COLUMN)) - 1
    return with_dataset(counted, dataset).withColumns({
        "position": position.cast("int"), "is_text": textual,
        "missing_pct": percent(F.col("missing"), F.col("row_count"))})


def row_accounting(raw: DataFrame, cleaned: DataFrame, plan_columns: DataFrame,
                   dataset: str) -> DataFrame:
    """Raw, cleaned and removed rows, and the empty columns removed."""
    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias(name)).withColumn(DATASET, F.lit(dataset))

    dropped = plan_columns.groupBy(DATASET).agg(
        F.sort_array(F.collect_list(F.when(F.col("dropped_empty"), F.col(COLUMN))))
        .alias("empty_columns_removed"))
    removed = F.col("row_count_raw") - F.col("row_count_cleaned")
    return (
        counted(raw, "row_count_raw").join(counted(cleaned, "row_count_cleaned"), DATASET)
        .join(dropped, DATASET, "left")
        .select(DATASET, "row_count_raw", "row_count_cleaned", removed.alias("rows_removed"),
                "empty_columns_removed")
    )


def missing_at_fit(raw: DataFrame, plan_columns: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame | None:
    """``missing_percent`` of ``raw`` from the counts of the fit, which saves another pass.

    For a plan that takes missing tokens as missing. None where the table has columns whose text the fit reads
    otherwise than :func:`missing_percent`.
    """
    if not all(isinstance(f.dataType, _SAME_TEXT) for f in raw.schema.fields if f.name not in exclude):
        return None
    missing = F.col("row_count") - F.col("non_null")
    return plan_columns.select(DATASET, COLUMN, "row_count", missing.alias("missing"),
                               percent(missing, F.col("row_count")).alias("missing_pct"))


def qc_columns(raw: DataFrame, cleaned: DataFrame, plan_columns: DataFrame, *, dataset: str,
               exclude: tuple[str, ...] = (), before: DataFrame | None = None,
               after: DataFrame | None = None) -> DataFrame:
    """Missing percentage before and after, and invalid values, per column.

    ``before`` and ``after`` are ``missing_percent``, ``missing_at_fit`` or ``column_metrics`` of a side that was
    measured already.
    """
    clean_names = dict(zip([c for c in raw.columns if c not in exclude],
                           names.standardize([c for c in raw.columns if c not in exclude])))
    renamed = raw.select(*[F.col(f"`{a}`").alias(b) for a, b in clean_names.items()])
    if before is None:
        before = missing_percent(renamed, dataset=dataset)
    if after is None:
        after = missing_percent(cleaned, dataset=dataset, exclude=exclude)
    before = before.select(DATASET, COLUMN, F.col("missing_pct").alias("missing_pct_raw"))
    after = after.select(DATASET, COLUMN, F.col("missing_pct").alias("missing_pct_cleaned"))
    return (
        before.join(after, [DATASET, COLUMN], "full_outer")
        .join(plan_columns.select(DATASET, COLUMN, "invalid"), [DATASET, COLUMN], "left")
    )


#: Rows of one key that are numbered together.
KEY_ROWS = 1 << 20


def _many(raw: DataFrame, cleaned: DataFrame, keys: list[str], most: int) -> DataFrame:
    """``_rows`` of the keys that have more than ``most`` rows on a side: at most one key for every ``most`` rows."""
    counts = [df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")) for df in (raw, cleaned)]
    both = counts[0].unionAll(counts[1]).where(F.col("n") > most).groupBy(*keys).agg(F.max("n").alias("_rows"))
    return materialize(both, "many")


def _same(keys: list[str]) -> Column:
    """Null keys are keys like any other."""
    same = F.lit(True)
    for c in keys:
        same &= F.col(f"x.`{c}`").eqNullSafe(F.col(f"y.`{c}`"))
    return same


def _ranged(rows: DataFrame, keys: list[str], parts: int) -> DataFrame:
    """``rows`` with the ``occurrence`` of each in its key, whose rows are spread over ranges of their order.

    A row's number is its place in its range and the rows of its key in the ranges before. Rows alike in all are
    told apart by the order they are read in, or copies of one row would fill a range.
    """
    place = ["_order", "body", "_read"]
    spread = rows.withColumn("_read", F.monotonically_increasing_id()).repartitionByRange(parts, *keys, *place)
    # Written once: the bounds of ranges are drawn anew whenever they are computed.
    spread = materialize(spread.withColumn("_range", F.spark_partition_id()), "spread")
    own = W.partitionBy(*keys, "_range")
    sizes = spread.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("n"))
    earlier = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select(*keys, "_range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    numbered = spread.withColumn("_place", F.row_number().over(own.orderBy(*place)))
    # A row for each range and each of its keys.
    met = numbered.alias("x").join(F.broadcast(sizes).alias("y"), _same([*keys, "_range"]))
    return met.select("x.*", (F.col("_place") + F.col("_before")).alias("occurrence"))


def _numbered(df: DataFrame, keys: list[str], order: list[str], body: Column, many: DataFrame, most: int) -> DataFrame:
    """``keys, slot, occurrence, body``: rows of a key numbered in their order; a slot is ``most`` of them."""
    placed = F.struct(*[F.col(f"`{c}`") for c in order]) if order else body
    rows = df.select(*keys, body.alias("body"), placed.alias("_order"))
    number = F.row_number().over(W.partitionBy(*keys).orderBy("_order", "body")).cast("long").alias("occurrence")
    total = many.agg(F.sum("_rows")).first()[0]
    if total is None:
        rows = rows.select("*", number)
    else:
        rows = materialize(rows.alias("x").join(F.broadcast(many).alias("y"), _same(keys), "left").select("x.*", "_rows"), "sides")
        few, hot = rows.where("_rows IS NULL").drop("_rows"), rows.where("_rows IS NOT NULL").drop("_rows")
        numbers = _ranged(hot, keys, 1 + total // most)
        rows = few.select("*", number).unionByName(numbers.select(*few.columns, "occurrence"))
    return rows.select(*keys, F.floor((F.col("occurrence") - 1) / most).alias("slot"), "occurrence", "body")


def row_changes(raw: DataFrame, cleaned: DataFrame, key: str | list[str], order_by: str | None = None, *,
                unique: bool = False, key_rows: int = KEY_ROWS) -> DataFrame:
    """All cell-by-cell changes of every row; ``raw`` carries cleaned names.

    Rows are matched by key and ``occurrence``: the rows of a key are numbered on both sides in the order of
    ``order_by``, a column that cleaning keeps, or of their text without one, and the k-th meets the k-th. So a
    repeated key multiplies no rows, and rows of one side only are those that its key has more of. A table without a
    key is matched by its row number as key. Rows of a key are numbered up to ``key_rows`` in one task; a key with more
    is numbered over many, in ranges of its order, with the same numbers. ``slot`` counts each ``key_rows`` of them.
    ``unique=True`` says that keys do not repeat and saves the numbering. Null keys are matched like others.
    """
    keys = [key] if isinstance(key, str) else list(key)
    order = [order_by] if order_by else []
    own = {*keys, *order}
    shared = list(dict.fromkeys(c for c in raw.columns + cleaned.columns if c not in own))
    null = F.lit(None).cast("string")

    def row(df: DataFrame) -> Column:
        return F.struct(*[(as_text(df, c) if c in df.columns else null).alias(c) for c in shared])

    if unique:
        sides = [df.select(*keys, F.lit(0).cast("long").alias("slot"), F.lit(1).cast("long").alias("occurrence"), row(df).alias("body"))
                 for df in (raw, cleaned)]
    else:
        many = _many(raw, cleaned, keys, key_rows)
        sides = [_numbered(df, keys, order, row(df), many, key_rows) for df in (raw, cleaned)]
    met = [*keys, "slot", "occurrence"]
    left, right = (side.select(F.struct(*met).alias("k"), F.col("body").alias(name))
                   for side, name in zip(sides, "ba"))
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"b.`{c}`").alias("before"),
                               F.col(f"a.`{c}`").alias("after")) for c in shared])
    changed = F.filter(pairs, lambda x: ~x["before"].eqNullSafe(x["after"]))
    both = F.col("b").isNotNull() & F.col("a").isNotNull()
    k = F.coalesce("x.k", "y.k")
    return (
        left.alias("x").join(right.alias("y"), F.col("x.k") == F.col("y.k"), "full_outer")
        .select(
            *[k[c].alias(c) for c in met],
            F.when(F.col("a").isNull(), F.lit("Only in the raw table."))
            .when(F.col("b").isNull(), F.lit("Only in the cleaned table.")).alias("note"),
            F.when(both, changed).otherwise(F.slice(changed, 1, 0)).alias("changes"))
        .withColumn("change_count", F.size("changes"))
    )


def row_diff_sample(raw: DataFrame, cleaned: DataFrame, key: str | list[str], limit: int = 5, **options) -> DataFrame:
    """The first changed or removed rows by key."""
    keys = [key] if isinstance(key, str) else list(key)
    changes = row_changes(raw, cleaned, key, **options)
    return (changes.filter((F.col("change_count") > 0) | F.col("note").isNotNull())
            .orderBy(*keys, "slot", "occurrence").limit(limit))


# --- summaries over report tables ---------------------------------------------
def column_renames(columns: DataFrame) -> DataFrame:
    """Columns whose clean name differs, in their order."""
    order = W.partitionBy(DATASET).orderBy("position")
    return (columns.filter(F.col("original_name") != F.col(COLUMN))
            .withColumn("rank", F.row_number().over(order))
            .select(DATASET, "rank", F.col("original_name").alias("from"), F.col(COLUMN).alias("to")))


def _listed(flag: Column) -> Column:
    """Names of the flagged columns in their order: at most the columns of one table."""
    pairs = F.array_sort(F.collect_list(F.when(flag, F.struct("position", F.col(COLUMN).alias("name")))))
    return F.transform(pairs, lambda x: x["name"])


def conversion_summary(plan_columns: DataFrame) -> DataFrame:
    kind = F.col("target_type")
    return plan_columns.groupBy(DATASET).agg(
        F.count(F.lit(1)).alias("columns"),
        *[F.count_if(kind == k).alias(f"{k}_columns") for k in ("string", "number", "date", "boolean")],
        F.sum("invalid").alias("invalid_total"),
        _listed(F.col("invalid") > 0).alias("invalid_columns"),
        _listed(F.col("coercion_skipped")).alias("skipped_columns"),
    )


def normalization_summary(plan_columns: DataFrame, privacy_mode: str) -> DataFrame:
    typed = F.col("target_type").isin("number", "date", "boolean")
    summary = plan_columns.groupBy(DATASET).agg(
        _listed(typed).alias("typed_columns"),
        F.count_if(typed).alias("typed_count"),
        *[_listed(F.col("privacy_transform") == t).alias(t)
          for t in ("columns_masked", "dates_generalized", "zip_truncated")],
        F.count("privacy_transform").alias("privacy_count"),
    )
    harbor = F.lit(privacy_mode == "safe_harbor")
    notes = F.array(
        F.when(F.col("typed_count") > 0, F.concat(
            F.col("typed_count").cast("string"), F.lit(" columns have a type other than text."))),
        F.when(harbor & (F.col("privacy_count") > 0),
               F.lit("Columns were masked by the Safe Harbor rules."))
        .when(harbor, F.lit("Safe Harbor is on, but no column fell under its rules.")),
    )
    return summary.withColumns({"privacy_mode": F.lit(privacy_mode), "notes": F.array_compact(notes)})


def change_summary(plan_columns: DataFrame, rows: DataFrame, streaming: bool = False) -> DataFrame:
    """What a run changed: renames, conversions, removals and the fields touched."""
    renamed = F.col("original_name") != F.col(COLUMN)
    touched = F.col("target_type").isNotNull() | renamed | F.col("dropped_empty")
    counted = plan_columns.groupBy(DATASET).agg(
        F.count_if(renamed).alias("renamed_columns"),
        F.count_if(F.col("target_type") != "string").alias("typed_columns"),
        F.count_if(F.col("dropped_empty")).alias("cols_removed"),
        F.count_distinct(F.when(touched, F.col(COLUMN))).alias("changed_fields_count"),
        F.sum("invalid").alias("invalid_total"),
    )
    out = counted.join(rows.select(DATASET, "rows_removed"), DATASET, "left")
    note = F.lit(rules.STREAM_DIFF_NOTE if streaming else "Rows were compared one by one.")
    return out.withColumn("note", note)


def merge_batches(metrics: DataFrame) -> DataFrame:
    """Percentages over all micro-batches from their counters."""
    merged = metrics.groupBy(DATASET, COLUMN).agg(
        *[F.sum(c).alias(c) for c in ("rows_raw", "rows_cleaned", "missing_raw", "missing_cleaned", "invalid")])
    return merged.withColumns({
        "missing_pct_raw": percent(F.col("missing_raw"), F.col("rows_raw")),
        "missing_pct_cleaned": percent(F.col("missing_cleaned"), F.col("rows_cleaned"))})


