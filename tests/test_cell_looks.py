"""Cells are looked at cheaply, with the results of a plain reading."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import functions as F

from claritable import rules
from claritable.functions import coerce, text
from workload.inputs import AS_OF

ODD = ["", " ", "\t", "N/A", " n/a\t", "unKnown", "unknown.", " null ", "-", "--", "é", "a  b", " a b ", "a\tb", "a\n",
       "a　　b", "a\x1cb", "nonbinary", " Male", " f", "x" * 40, "x" * 40 + "  y", None]


def plan_text(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_date_reading_holds_few_copies_of_its_rare_part(spark):
    df = spark.createDataFrame([("1/2/2024",)], "v string").localCheckpoint()
    assert plan_text(df.select(coerce.timestamp(F.col("v"), AS_OF))).count("wed(?:nes)?") <= 2


def test_dates_of_all_forms(spark):
    forms = {"2024-1-2": "2024-01-02 00:00:00", "2024-01-02T23:30:00-0500": "2024-01-03 04:30:00", "1/2/2024": "2024-01-02 00:00:00",
             "13/2/2024": "2024-02-13 00:00:00", "0/2/2024": None, "2024/01.2": "2024-01-02 00:00:00", "1-2-75": "1975-01-02 00:00:00",
             "Mon, Feb 3, 2025 4:05 pm": "2025-02-03 16:05:00", "20240102T030405": "2024-01-02 03:04:05", "2024-03": "2024-03-01 00:00:00",
             "1/2/2024\n": "2024-01-02 00:00:00", "pending": None, "12:30": None, "12/31/2024 10:00": "2024-12-31 10:00:00"}
    df = spark.createDataFrame([(k, v) for k, v in forms.items()], "v string, want string")
    got = df.select("v", "want", coerce.timestamp(F.col("v"), dt.date(2024, 1, 1)).cast("string").alias("got")).collect()
    assert [(r.v, r.got) for r in got] == [(r.v, r.want) for r in got]


def test_tokens_and_spaces_of_odd_cells(spark):
    v = F.col("v")
    got = spark.createDataFrame([(x,) for x in ODD], "v string").select(
        v, text.is_missing_token(v), text.collapse(v), text.has_text(v)).collect()
    for value, missing, collapsed, filled in got:
        if value is None:
            assert missing is None and collapsed is None
            continue
        bare = re.sub(r"^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "", value) if "\x1c" not in value else value
        assert missing == (bare.lower() in rules.MISSING_TOKENS), value
        assert collapsed == re.sub(r"[\t-\r \x85\xa0　]+", " ", value).strip(" "), value
        assert filled == bool(bare), value
