"""Typed readings are settled once for each cell, and digits are cut as before."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from claritable.functions import text
from workload.cleaning import claims_plan
from workload.inputs import claims

SF = "/root/testdata/sf0.001"


def test_cells_share_one_reading(spark):
    plan = claims_plan(spark, SF)
    done = plan.project(claims(spark, SF))._jdf.queryExecution().optimizedPlan().toString()
    for name in ("service_date", "paid_amount", "accepted_flag"):
        assert f"AS p:{name}" in done


def test_digits_of_odd_cells(spark):
    odd = ["", "x", "1", "(312) 555-0100 x9", "12345678901234", "0002-8215-01", "54868-5882-0", "٣٤", "12\n", "60601-1234", None]
    rows = spark.createDataFrame([(v,) for v in odd], "v string")
    v = F.col("v")
    got = rows.select("v", text.normalize_phone(v), text.normalize_postal(v), text.normalize_ndc(v), text.normalize_rxnorm(v)).collect()
    for value, phone, postal, ndc, rxnorm in got:
        d = None if value is None else re.sub(r"[^0-9]+", "", value) or None
        assert (phone, postal, rxnorm) == (d and d[-10:], d and d[:5], d)
        assert ndc == (("0" + d if len(d) == 10 else d) if d else None)
