"""Delimiter inference over any number of text files in one job."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claritable.sources.tables import read_delimited

# Candidate delimiters, the first one wins a tie.
CANDIDATES = (",", "\t", ";", "|")


def detect_delimiters(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``(file, delimiter)``: the candidate with the same non-zero count on every line.

    Counts are taken outside double quotes.  Without a steady candidate the most
    frequent one per line wins, and a comma when none occurs.
    """
    value = F.regexp_replace("value", r'"[^"]*"', "")
    lines = spark.read.text(paths).filter(F.length(F.trim("value")) > 0).select(
        F.col("_metadata.file_path").alias("file"),
        *[(F.length(value) - F.length(F.replace(value, F.lit(d), F.lit("")))).alias(f"c{i}")
          for i, d in enumerate(CANDIDATES)])
    counts = lines.groupBy("file").agg(
        *[f for i in range(len(CANDIDATES))
          for f in (F.min(f"c{i}").alias(f"low{i}"), F.max(f"c{i}").alias(f"high{i}"),
                    F.avg(f"c{i}").alias(f"mean{i}"))])
    ranked = [F.struct(
        ((F.col(f"low{i}") == F.col(f"high{i}")) & (F.col(f"low{i}") > 0)).alias("steady"),
        F.col(f"mean{i}").alias("mean"), F.lit(-i).alias("preference"), F.lit(d).alias("delimiter"))
        for i, d in enumerate(CANDIDATES)]
    best = F.greatest(*ranked)
    return counts.select("file", best["delimiter"].alias("delimiter"), best["steady"].alias("steady"))


def read_mixed(spark: SparkSession, paths: str | list[str], multiline: bool = True) -> DataFrame:
    """Read files of different delimiters into one all-string table.

    The file list, not file contents, is grouped on the driver: one scan per delimiter.
    """
    groups = detect_delimiters(spark, paths).groupBy("delimiter").agg(F.collect_list("file").alias("files"))
    parts = [read_delimited(spark, row["files"], row["delimiter"], multiline) for row in groups.collect()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
