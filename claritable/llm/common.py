"""What the operators share: reading a table, row keys, cutting lineage, word and line rules."""

from __future__ import annotations

import functools
import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: White space of the contracts: space and the controls from tab to carriage return.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` gives the same rows in DuckDB."""
    def add(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share; a temporary one where the session names none and has one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    held = spark.sparkContext.getCheckpointDir()
    if held:
        return held.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="llm-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """Write rows to the shared folder once and go on from there, so that later steps see the same rows and
    neither recompute them nor lose them with an executor."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def words_of(text: Column) -> Column:
    """Array of the words of a text; empty for a null or blank one."""
    bare = F.coalesce(trimmed(text), F.lit(""))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_RUN))


def nested(docs: DataFrame, **columns: Column) -> DataFrame:
    """Each row as ``doc``, with columns of its own beside it that cannot clash with the input's."""
    return docs.select(F.struct("*").alias("doc"), *[column.alias(name) for name, column in columns.items()])


def unnested(rows: DataFrame, docs: DataFrame, **columns: Column) -> DataFrame:
    """The rows of ``docs`` again; ``columns`` are added and take the place of the input's of the same name."""
    taken = {name.lower() for name in columns}
    return rows.select(*[F.col("doc")[name].alias(name) for name in docs.columns if name.lower() not in taken],
                       *[column.alias(name) for name, column in columns.items()])


def same(*names: str) -> Callable[[str, str], Column]:
    """Null-safe equality of columns that two frames under the given aliases share."""
    def on(a: str, b: str) -> Column:
        return functools.reduce(lambda x, y: x & y, (F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}")) for n in names))
    return on
