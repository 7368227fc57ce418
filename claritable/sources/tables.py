"""Reading and writing tables: format by extension, paging, row counts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claritable.operators.cells import as_text
from claritable.sources import records

# Format of each file extension.
FORMATS = {"csv": "csv", "tsv": "tsv", "txt": "csv", "jsonl": "jsonl", "ndjson": "jsonl",
           "parquet": "parquet"}
#: An extension after that of the format: text is compressed.
COMPRESSED = ".lz4"
_EXTENSION = re.compile(rf"\.([A-Za-z0-9]+)({re.escape(COMPRESSED)})?/?$")


def detect_format(path: str) -> str:
    match = _EXTENSION.search(path)
    return FORMATS.get(match.group(1).lower(), "csv") if match else "csv"


def delimited_options(sep: str = ",") -> dict[str, str]:
    """What readers and writers of delimited text agree on, batch and streaming alike."""
    return {"header": "true", "sep": sep, "quote": '"', "escape": '"', "encoding": "UTF-8",
            # Cells come back as they were, white space and empty text included.
            "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "emptyValue": '""'}


def _reading(sep: str, multiline: bool) -> dict[str, str]:
    return {**delimited_options(sep), "emptyValue": "", "inferSchema": "false", "multiLine": str(multiline).lower()}


def read_delimited(spark: SparkSession, path: str | list[str], sep: str = ",",
                   multiline: bool = True, whole_files: bool = False) -> DataFrame:
    """Delimited text with every column a string; line breaks inside quotes belong to their cell.

    Large files are split between tasks, also inside cells (``sources/records.py``).  ``whole_files=True``
    reads each file in one task by Spark's own reader; it is for lines that end with a carriage return alone.

    ``multiline=False`` is for files whose cells hold no line breaks, and saves settling where records begin:
    a line with an odd number of quotes raises.
    """
    if multiline and not whole_files:
        # The first record of one file names the columns.
        whole = spark.read.options(**_reading(sep, True)).csv(path)
        if not whole.columns:
            return whole  # files without a line
        named = [*whole.columns[:-1], whole.columns[-1].rstrip("\r")]
        return records.parse(records.records(spark, path, sep), named, _reading(sep, True))
    if not multiline:
        quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
        if not spark.read.text(path).filter(quotes % 2 == 1).isEmpty():
            raise ValueError("a quoted cell spans lines; read with multiline=True")
    return spark.read.options(**_reading(sep, multiline)).csv(path)


def read_delimited_stream(spark: SparkSession, path: str, columns: list[str], sep: str = ",",
                          files_per_trigger: int | None = None, multiline: bool = True) -> DataFrame:
    """A folder of delimited files as a stream of all-string rows; the schema is fixed up front."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    reader = spark.readStream.schema(schema).options(**_reading(sep, multiline))
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.csv(path)


def read_table(spark: SparkSession, path: str, fmt: str | None = None, *, sep: str | None = None,
               multiline: bool = True) -> DataFrame:
    """Read by extension or by ``fmt``; nested JSON values become JSON text."""
    kind = fmt or detect_format(path)
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "jsonl":
        return flatten_nested(spark.read.json(path))
    if kind == "tsv":
        return read_delimited(spark, path, "\t", multiline)
    if kind == "csv":
        return read_delimited(spark, path, sep or ",", multiline)
    raise ValueError(f"unsupported format {kind!r}")


def flatten_nested(df: DataFrame) -> DataFrame:
    nested = (T.ArrayType, T.StructType, T.MapType)
    return df.select(*[
        as_text(df, f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`")
        for f in df.schema])


def write_table(df: DataFrame, path: str, fmt: str | None = None, mode: str = "errorifexists") -> None:
    """Write CSV or TSV with a header, JSON lines with null keys kept, or typed Parquet.

    Text goes compressed to a path like ``x.csv.lz4``. Such a file is written as fast and read by one task, so it is
    for tables that many tasks write.
    """
    kind = fmt or detect_format(path)
    writer = df.write.mode(mode)
    match = _EXTENSION.search(path)
    if kind != "parquet" and match and match.group(2):
        writer = writer.option("compression", "lz4")
    if kind in ("csv", "tsv"):
        writer.options(**delimited_options("\t" if kind == "tsv" else ",")).csv(path)
    elif kind == "jsonl":
        writer.option("ignoreNullFields", False).json(path)
    elif kind == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unsupported format {kind!r}")


def preview(df: DataFrame, order_by: str | Column, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page of rows in key order; only ``offset + limit`` rows per task are kept.

    For pages deep in a large table use :func:`page_after`.
    """
    return df.orderBy(order_by).offset(offset).limit(limit)


def page_after(df: DataFrame, key: str, after=None, limit: int = 50) -> DataFrame:
    """The rows whose key follows ``after``; each task keeps ``limit`` rows however deep the page lies."""
    rows = df if after is None else df.filter(F.col(key) > F.lit(after))
    return rows.orderBy(key).limit(limit)


def counted_preview(df: DataFrame, order_by: str | Column, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page with the table's ``row_count`` beside every row."""
    return preview(df, order_by, limit, offset).withColumn("row_count", F.lit(df.count()).cast("bigint"))


def row_count(spark: SparkSession, path: str, fmt: str | None = None) -> int:
    """Exact rows: Parquet footers, lines of JSON, or records of delimited text."""
    kind = fmt or detect_format(path)
    if kind == "parquet":
        return spark.read.parquet(path).count()
    return int(rows_per_file(spark, path, kind).agg(F.sum("row_estimate").alias("n")).first()["n"] or 0)


def rows_per_file(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """``file, bytes, row_estimate``: the records of every text file, less its header.

    A record of delimited text counts once however many lines its cells have. All are counted, with counts
    combined in each task.
    """
    kind = fmt or detect_format(path)
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"))
    files = lines.groupBy("file").agg(F.max("bytes").alias("bytes"), F.count(F.lit(1)).alias("n"))
    if kind in ("csv", "tsv"):
        found = records.records(spark, path, "\t" if kind == "tsv" else ",").groupBy("file").agg(F.count(F.lit(1)).alias("n"))
        files = files.drop("n").join(found, "file", "left")  # a row for each file
    return files.select("file", "bytes", F.coalesce("n", F.lit(0)).cast("bigint").alias("row_estimate"))
