"""Compare registered queries with their SQL on one scale: ``python -m tests.check_oracle [name or module*...]``."""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
SF = "/root/testdata/sf0.01"


def connect(sf: str = SF) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
            return "NULL"
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return str(bool(v))
        if isinstance(v, (int, float)) or hasattr(v, "dtype"):
            return f"{float(v):.9g}"
        return str(v)
    columns = sorted(df.columns)
    return sorted(tuple(cell(v) for v in row) for row in df[columns].itertuples(index=False, name=None))


def compare(spark: SparkSession, con, name: str, sf: str = SF) -> tuple[bool, str]:
    from workload.catalog import ORACLES, QUERIES
    started = time.time()
    got = QUERIES[name](spark, sf).toPandas()
    spent = time.time() - started
    if name not in ORACLES:
        return len(got) > 0, f"rows only: {len(got)} ({spent:.1f}s)"
    want = con.execute(ORACLES[name]).df()
    if sorted(got.columns) != sorted(want.columns):
        return False, f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    a, b = canonical(got), canonical(want)
    if a == b:
        return True, f"{len(a)} rows ({spent:.1f}s)"
    only_a, only_b = sorted(set(a) - set(b))[:3], sorted(set(b) - set(a))[:3]
    return False, f"{len(a)} vs {len(b)} rows\n  cols {sorted(got.columns)}\n  spark {only_a}\n  sql   {only_b}"


def main(names: list[str]) -> int:
    from workload.catalog import QUERIES
    spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
             .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    con, bad = connect(), 0
    wanted = [n for n in QUERIES if not names or n in names
              or any(x.endswith("*") and QUERIES[n].__module__ == f"workload.{x[:-1]}" for x in names)]
    for name in wanted:
        try:
            ok, text = compare(spark, con, name)
        except Exception as error:
            ok, text = False, f"{type(error).__name__}: {str(error)[:600]}"
        bad += not ok
        print(("ok   " if ok else "FAIL ") + name, text, flush=True)
    print(f"{bad} failed")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
