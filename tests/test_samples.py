"""Samples by hash: the same however rows lie, mergeable, and as near to the table as they say."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from claritable.operators import profile
from workload import inputs
from workload.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


def keys(frame):
    return sorted(r["row_id"] for r in frame.select("row_id").collect())


def test_samples_do_not_depend_on_partitions_and_merge(spark):
    rows = inputs.messy(spark, SF)
    sample = profile.bottom_sample(rows, 300, "row_id")
    want = keys(sample)
    assert want != sorted(range(1, 301)) and len(want) == 300
    assert keys(profile.bottom_sample(rows.repartition(7, "notes"), 300, "row_id")) == want
    assert keys(profile.bottom_sample(rows.orderBy(F.desc("row_id")).coalesce(1), 300, "row_id")) == want
    halves = [profile.bottom_sample(rows.where(c), 300, "row_id") for c in ("row_id < 400", "row_id >= 400")]
    assert keys(profile.bottom_sample(halves[0].unionAll(halves[1]), 300, "row_id")) == want


def test_repeated_null_and_unnamed_keys(spark):
    rows = spark.createDataFrame([(None, "x"), (None, "x"), (1, None), (1, "b"), (2, "c")], "row_id long, t string")
    assert profile.bottom_sample(rows, 9, "row_id").count() == 5
    assert profile.bottom_sample(rows, 3).collect() == profile.bottom_sample(rows.repartition(4), 3).collect()
    assert profile.bottom_sample(rows.limit(0), 3).collect() == []


@pytest.mark.parametrize("n", [500, 4000])
def test_shares_lie_within_the_stated_error(spark, n):
    rows = inputs.claims(spark, SF).cache()
    total = rows.count()
    flags = {"missing date": "service_date = 'n/a'", "icd": "icd_code = 'None'", "accepted": "accepted_flag = 'Y'",
             "gender": "gender = 'm'", "notes": "notes = ''", "hot": "claim_id = 'CLM-0000000'"}
    shares = lambda df: df.agg(*[F.avg(F.expr(c).cast("int")).alias(k) for k, c in flags.items()]).first().asDict()
    found, true = shares(profile.bottom_sample(rows, n, "row_id")), shares(rows)
    for name, share in found.items():
        assert abs(share - true[name]) <= profile.sample_error(share, n, total, risk=0.001), name
    # The first rows would not do as well: the table is sorted.
    assert profile.sample_error(0.5, total, total) == 0 and profile.sample_error(0.5, n, total) < 0.06
    rows.unpersist()


def test_the_registered_profile_reads_every_row(spark):
    rows = inputs.messy(spark, SF).count()
    assert {r["row_count"] for r in QUERIES["profile_sampled"](spark, SF).collect()} == {rows}
    assert " LIMIT 500" not in ORACLES["profile_sampled"]
