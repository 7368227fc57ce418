"""Delimited text whose quoted cells hold line breaks, read in byte ranges by many tasks.

Spark's own reader gives such a file to one task, since a range may begin inside a cell. Here every range is read for
itself, and what it means is settled afterwards:

1. Each range finds, for both cases (it begins between records, or inside a quoted cell), whether it ends inside one,
   where its first record begins and where its last, unfinished one does. A line without a quote changes nothing.
2. The ranges of each file are walked in order, a row for each: the end of one is the beginning of the next.
3. Lines of records that cross the end of a range meet by the range in which the record began; all others become
   records where they are read. Only the crossing lines are shuffled, and each line is parsed by Spark's CSV functions.

A quote opens a cell only at its beginning; behind the closing quote a cell goes on to the delimiter, as Spark reads it.
Records end with a line feed, with or without a carriage return before it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claritable.sources.scratch import materialize

_LINE = "file string, start long, id long, value string"
_ENDS = "file string, start long, first long, open_out long, open_in long, head long, ends_in boolean"
_RANGE = "file string, start long, first long, origin long, head long, open long"


def open_cells(sep: str) -> tuple[re.Pattern, re.Pattern]:
    """Lines that end inside a quoted cell: of those that begin a record, of those that begin inside such a cell."""
    s, quoted = re.escape(sep), r'[^"]*+(?:""[^"]*+)*+'
    begun = rf'(?:(?:"{quoted}"[^{s}]*+|[^"{s}][^{s}]*+|){s})*+"{quoted}'
    return re.compile(begun, re.S), re.compile(rf'{quoted}(?:"[^{s}]*+{s}{begun})?+', re.S)


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines in the order of their ranges: ``id`` grows along a range."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("id"), "value")


#: Bytes of lines that are taken as Python values at once.
_AT_ONCE = 8 << 20


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of long lines cut into smaller ones."""
    for batch in batches:
        n = max(1, batch.num_rows * _AT_ONCE // max(_AT_ONCE, batch.nbytes))
        for at in range(0, batch.num_rows, n):
            yield batch.slice(at, n)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[column.to_pylist() for column in batch.columns], strict=True)


def _ends(sep: str):
    """One row for each range, for both ways in which it may begin."""
    begun, inside = open_cells(sep)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[list] = []
        out = within = None  # first line of the open record, if there is one, in either case
        for file, start, i, value in _rows(_parts(batches)):
            if not found or found[-1][:2] != [file, start]:
                # Inside from the beginning: the open record began before this range.
                found.append([file, start, i, None, None, None, True])
                out, within = None, -1
            if value is not None:
                out, within = _step(out, i, value, begun, inside), _step(within, i, value, begun, inside)
            last = found[-1]
            if within != -1 and last[5] is None:
                last[5] = i  # the last line of the record from before
            last[3], last[4], last[6] = out, None if within == -1 else within, within == -1
        columns = list(zip(*found, strict=True)) or [[]] * 7
        kinds = [pa.string()] + [pa.int64()] * 5 + [pa.bool_()]
        names = [x.split()[0] for x in _ENDS.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return scan


def _step(first: int | None, i: int, value: str, begun: re.Pattern, inside: re.Pattern) -> int | None:
    """The first line of the record that is open after line i, if one is."""
    if first is None:
        return i if begun.fullmatch(value) else None
    return first if inside.fullmatch(value) else None


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges in their order, each with the range in which the record open at its beginning began."""
    here, origin = None, None
    for batch in batches:
        found = []
        for file, start, first, open_out, open_in, head, ends_in in _rows([batch]):
            if file != here:
                here, origin = file, None
            if origin is None:
                found.append((file, start, first, None, None, open_out))
                origin = None if open_out is None else start
            else:
                # Without an end of its own, the record fills the range.
                found.append((file, start, first, origin, head, open_in))
                origin = origin if ends_in else None if open_in is None else start
        columns = list(zip(*found, strict=True)) or [[]] * 6
        names = [x.split()[0] for x in _RANGE.split(", ")]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.string() if k == 0 else pa.int64()) for k, c in enumerate(columns)], names)


def _whole(sep: str):
    """Records that lie within their range; the file's first one, its header, is left out."""
    begun, inside = open_cells(sep)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []
        header = False
        for batch in _parts(batches):
            found = []
            for file, first, i, value in _rows([batch]):
                if not held:
                    header = i == first
                held.append(value)
                if '"' in value and (inside if len(held) > 1 else begun).fullmatch(value) or (
                        len(held) > 1 and '"' not in value):
                    continue
                if not header:
                    found.append((file, "\n".join(held) if len(held) > 1 else value))
                held = []
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.string()) for k in (0, 1)],
                                             ["file", "record"])

    return scan


def records(spark: SparkSession, path: str | list[str], sep: str = ",") -> DataFrame:
    """``file, record``: the text of every record of the files but their headers and empty lines."""
    lines = _lines(spark, path)
    marked = lines.withColumn("value", F.when(F.contains("value", F.lit('"')), F.col("value")))
    ends = marked.mapInArrow(_ends(sep), _ENDS)
    # One row for each range.
    ranges = materialize(ends.repartition("file").sortWithinPartitions("file", "start").mapInArrow(_walk, _RANGE), "ranges")
    at = lines.join(F.broadcast(ranges), ["file", "start"], "left")
    # Ranges are the same whenever the files are read under the same settings.
    at = at.withColumn("first", F.coalesce("first", F.raise_error(F.lit("the files or the size of ranges have changed"))))
    before = F.col("origin").isNotNull() & (F.col("head").isNull() | (F.col("id") <= F.col("head")))
    after = F.coalesce(F.col("id") >= F.col("open"), F.lit(False))
    top = F.when(F.col("start") == 0, F.col("first"))
    whole = at.where(~before & ~after).select("file", F.coalesce(top, F.lit(-1)).alias("first"), "id", "value").mapInArrow(
        _whole(sep), "file string, record string")
    if ranges.where("origin IS NOT NULL").isEmpty() and ranges.where("open IS NOT NULL").isEmpty():
        return _bare(whole)
    crossing = at.where(before | after).select(
        "file", F.when(before, F.col("origin")).otherwise(F.col("start")).alias("origin"),
        F.struct("start", "id", "value").alias("line"), (top == F.col("id")).alias("header"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list("line")), lambda x: x["value"]), "\n")
    crossing = crossing.groupBy("file", "origin").agg(
        joined.alias("record"), F.coalesce(F.max("header"), F.lit(False)).alias("header"))
    return _bare(whole.unionAll(crossing.where("NOT header").select("file", "record")))


def _bare(found: DataFrame) -> DataFrame:
    return found.select("file", F.regexp_replace("record", r"\r$", "").alias("record")).where(F.col("record") != "")


def parse(rows: DataFrame, columns: list[str], options: dict[str, str]) -> DataFrame:
    """Records as columns of text."""
    schema = T.StructType([T.StructField(f"c{k}", T.StringType()) for k in range(len(columns))])
    cells = F.from_csv("record", schema.simpleString()[7:-1].replace(":", " "), options)
    read = rows.select(cells.alias("r"))
    return read.select(*[F.col(f"r.c{k}").alias(name) for k, name in enumerate(columns)])
