"""Retrieval text: text statistics per column, a context column and the retrieval projection."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claritable import rules
from claritable.functions import coerce, names, pii, text
from claritable.operators.cells import COLUMN, DATASET, VALUE, as_text, cells
from claritable.operators.qc import is_text

CONTEXT = "rag_context"


def text_candidates(metrics: DataFrame) -> DataFrame:
    """Non-blank share and average length of the open text columns in ``qc.column_metrics``."""
    filled = F.col("non_null") > 0
    return (
        metrics.filter(F.col("is_text") & ~names.any_token(F.col(COLUMN), rules.NON_TEXT_NAME_TOKENS))
        .select(DATASET, "position", COLUMN,
                F.when(filled, F.col("non_blank") / F.col("non_null")).otherwise(F.lit(0.0))
                .alias("non_empty_ratio"),
                F.when(filled, F.col("total_length") / F.col("non_null")).otherwise(F.lit(0.0))
                .alias("avg_len"))
    )


def is_chunkable() -> Column:
    return (F.col("non_empty_ratio") >= 0.50) & F.col("avg_len").between(40, 500)


def _first_share(rows: DataFrame, width: Column, share: float) -> DataFrame:
    """The first rows by position, at most ``share`` of the table's columns but at least one."""
    limit = F.greatest(F.lit(1), F.floor(F.greatest(F.lit(1.0), width * share)))
    order = W.partitionBy(DATASET).orderBy("position")
    return rows.withColumn("drop_rank", F.row_number().over(order)).filter(F.col("drop_rank") <= limit)


def low_signal_columns(metrics: DataFrame, share: float = 0.2) -> DataFrame:
    """Text columns that are mostly blank or very short, at most ``share`` of the table's columns."""
    width = metrics.groupBy(DATASET).agg(F.count(F.lit(1)).alias("width"))
    weak = text_candidates(metrics).filter(
        (F.col(COLUMN) != CONTEXT) & ~names.any_token(F.col(COLUMN), rules.PROTECTED_NAME_TOKENS)
        & ((F.col("non_empty_ratio") < 0.35) | (F.col("avg_len") < 8)))
    return _first_share(weak.join(width, DATASET), F.col("width"), share).drop("width")


def high_missing_columns(metrics: DataFrame, share: float = 0.15) -> DataFrame:
    """Columns at least 92 % missing, at most ``share`` of the table's columns."""
    width = metrics.groupBy(DATASET).agg(F.count(F.lit(1)).alias("width"))
    sparse = metrics.filter(
        (F.col("missing_pct") >= 92) & ~names.any_token(F.col(COLUMN), rules.PROTECTED_NAME_TOKENS)
    ).select(DATASET, "position", COLUMN, "missing_pct")
    return _first_share(sparse.join(width, DATASET), F.col("width"), share).drop("width")


def pii_named_columns(columns: Iterable[str]) -> list[str]:
    return [c for c in columns if names.contains_any(c, rules.PII_COLUMN_TOKENS)]


# --- context ----------------------------------------------------------------
def value_counts(df: DataFrame, columns: list[str]) -> dict[str, int]:
    """Distinct non-null values per column; one row per column reaches the driver."""
    if not columns:
        return {}
    distinct = (
        cells(df, {c: c for c in columns}, with_row=False).filter(F.col(VALUE).isNotNull())
        .groupBy(COLUMN, VALUE).agg(F.lit(1).alias("one"))
        .groupBy(COLUMN).agg(F.count(F.lit(1)).alias("n"))
    )
    found = {r[COLUMN]: r["n"] for r in distinct.collect()}
    return {c: found.get(c, 0) for c in columns}


def context_columns(df: DataFrame, exclude: tuple[str, ...] = (), *, limit: int | None = None,
                    variety: dict[str, int] | None = None) -> list[str]:
    """The columns that say most about a row: narrative text first, then by variety.

    ``variety`` gives distinct counts, from a profile for instance; without it they are counted.
    """
    open_columns = [c for c in df.columns if c not in exclude and c != CONTEXT
                    and not names.contains_any(c, rules.PII_COLUMN_TOKENS)]
    variety = value_counts(df, open_columns) if variety is None else variety

    def rank(name: str):
        signal = 3 * is_text(df, name) + 3 * names.contains_any(name, rules.NARRATIVE_TOKENS)
        return (-signal, -variety[name], df.columns.index(name))

    return sorted((c for c in open_columns if variety.get(c)), key=rank)[:limit]


def _with_pairs(df: DataFrame, values: dict[str, Column], fallback: Column, suffix: str,
                max_chars: int | None) -> DataFrame:
    """Append ``rag_context``: ``name=value`` pairs of a row, or the fallback; short texts get a sentence.

    Values, pairs and text are projections of their own: each is computed once and stays
    in generated code however often the next one reads it.
    """
    own = [F.col(f"`{c}`") for c in df.columns]
    rows = df.select(*own, *[v.alias(f"v:{i}") for i, v in enumerate(values.values())], fallback.alias("v:none"))
    pairs = F.concat_ws("; ", *[
        F.when(~text.is_missing_token(F.col(f"`v:{i}`")), F.concat(F.lit(f"{name}="), F.col(f"`v:{i}`")))
        for i, name in enumerate(values)])
    rows = rows.select(*own, "`v:none`", pairs.alias("v:pairs"))
    filled = F.when(F.col("`v:pairs`") == "", F.col("`v:none`")).otherwise(F.col("`v:pairs`"))
    rows = rows.select(*own, filled.alias("v:text"))
    whole, size = F.col("`v:text`"), F.length(F.col("`v:text`"))
    out = F.when(size < rules.CONTEXT_MIN, F.concat(whole, F.lit(suffix)))
    if max_chars is not None:
        out = out.when(size > max_chars, F.regexp_replace(F.left(whole, F.lit(max_chars)), r"(?U)\s+$", ""))
    return rows.select(*own, out.otherwise(whole).alias(CONTEXT))


def with_context(df: DataFrame, row_id: str, columns: list[str] | None = None, *, max_chars: int | None = None) -> DataFrame:
    """Append ``rag_context``; rows without any value are named by their id.

    Columns are chosen from the data unless given.  Nothing is cut unless ``max_chars`` says
    so; :func:`chunked` deals long texts out to rows.
    """
    chosen = context_columns(df, (row_id,)) if columns is None else columns
    if not chosen:
        before, after = rules.CONTEXT_FALLBACK.split("{row}")
        return df.withColumn(CONTEXT, F.concat(F.lit(before), F.col(row_id).cast("string"), F.lit(after)))
    return _with_pairs(df, {c: text.strip(as_text(df, c)) for c in chosen},
                       F.concat(F.lit("row="), F.col(row_id).cast("string")), rules.CONTEXT_SUFFIX, max_chars)


def chunked(df: DataFrame, column: str = CONTEXT, size: int = rules.CHUNK_CHARS) -> DataFrame:
    """A row for each ``size`` characters of a text, numbered from 0 in ``chunk``; all of the text is kept."""
    last = F.greatest(F.lit(1), F.ceil(F.length(column) / size)) - 1
    rows = df.withColumn("chunk", F.explode(F.sequence(F.lit(0), last.cast("int"))))
    return rows.withColumn(column, F.substr(F.col(column), F.col("chunk") * size + 1, F.lit(size)))


# --- projection -------------------------------------------------------------
def _first(columns: list[str], tokens: Iterable[str], without: Iterable[str] = ()) -> str | None:
    return next((c for c in columns if names.contains_any(c, tokens)
                 and not (without and names.contains_any(c, without))), None)


def retrieval_projection(df: DataFrame, row_id: str, as_of: dt.date, *, max_columns: int | None = None,
                         max_chars: int | None = None) -> DataFrame:
    """``record_id, event_date, domain_code, rag_context`` of every row, free of PII.

    A projection without a shuffle: rows without an id take ``row_<row_id>``, rows without a date
    ``as_of``, rows without a code ``GENERAL``.
    """
    columns = [c for c in df.columns if c != row_id]
    own_id = F.concat(F.lit("row_"), F.col(row_id).cast("string"))
    id_column = _first(columns, ("id",), rules.PII_COLUMN_TOKENS)
    record = own_id
    if id_column:
        stripped = text.strip(as_text(df, id_column))
        record = F.coalesce(F.when(stripped != "", stripped), own_id)

    today = F.lit(as_of.isoformat())
    date_column = _first(columns, ("date", "dob"))
    event = today
    if date_column:
        c, kind = F.col(f"`{date_column}`"), df.schema[date_column].dataType
        moment = c if isinstance(kind, (T.DateType, T.TimestampType)) else coerce.timestamp(
            c.cast("string"), as_of)
        event = F.coalesce(F.date_format(moment, "yyyy-MM-dd"), today)

    code_column = _first(columns, rules.CODE_NAME_TOKENS)
    code = F.lit("GENERAL")
    if code_column:
        stripped = text.strip(as_text(df, code_column))
        code = F.upper(F.coalesce(F.when(stripped != "", stripped), F.lit("general")))

    open_columns = [c for c in columns if c not in ("record_id", "event_date", "domain_code", CONTEXT)
                    and not names.contains_any(c, rules.PII_COLUMN_TOKENS)][:max_columns]
    values = {c: pii.retrieval_text(as_text(df, c)) for c in open_columns}
    fallback = F.concat(F.lit("record_id="), record, F.lit(f"; {rules.PROJECTION_FALLBACK}"))
    rows = df.select(*[F.col(f"`{c}`") for c in dict.fromkeys(open_columns)],
                     record.alias("p:record"), event.alias("p:event"), code.alias("p:code"), fallback.alias("p:none"))
    found = _with_pairs(rows, values, F.col("`p:none`"), rules.PROJECTION_SUFFIX, max_chars)
    return found.select(F.col("`p:record`").alias("record_id"), F.col("`p:event`").alias("event_date"),
                        F.col("`p:code`").alias("domain_code"), CONTEXT)
