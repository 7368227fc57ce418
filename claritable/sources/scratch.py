"""Shared scratch space for tables a job writes and reads back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CONF = "spark.checkpoint.dir"
_local: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Without that setting a temporary folder stands in on one machine; a cluster, whose
    machines would each write to a folder of their own, raises.
    """
    named = spark.conf.get(CONF, None) or spark.sparkContext.getConf().get(CONF, None)
    if named:
        return named
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError(f"set {CONF} to a folder that all machines of the cluster share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="claritable-")
    return _local[app]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/claritable/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write once and read back, so later jobs neither recompute nor depend on lost executors."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
