"""What a run has measured is not measured again."""

from __future__ import annotations

from pyspark.sql import functions as F

from claritable.operators import dedup, qc
from claritable.options import CleanOptions
from claritable.plans.cleaning import fit
from claritable.plans.runs import clean_run, duplicates_left
from workload.cleaning import CLAIMS_HINTS
from workload.inputs import AS_OF, claims

SF = "/root/testdata/sf0.001"
ODD = ["", " ", "\t", "N/A", " n/a\t", "unKnown", "unknown.", " null ", "-", "--", "é", "a  b", " a b ", "a\tb", "a\n",
       "a　　b", "a\x1cb", "nonbinary", " Male", " f", "x" * 40, "x" * 40 + "  y", None]


def plan_text(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_run_reports_are_measured_once(spark):
    run = clean_run(claims(spark, SF), dataset="claims", options=CleanOptions(as_of=AS_OF), hints=CLAIMS_HINTS, exclude=("row_id",))
    for report in (run.issues, run.columns):
        assert "Aggregate" not in plan_text(report) and "Join" not in plan_text(report)


def test_missing_counts_of_the_fit_are_those_of_a_pass(spark):
    df = spark.createDataFrame([(x, 1.5 if x else None, [x] if x else None, i % 2 == 0) for i, x in enumerate(ODD)],
                               "A string, b double, c array<string>, d boolean")
    plan = fit(df, CleanOptions(as_of=AS_OF), hints={})
    known = qc.missing_at_fit(df, plan.conversion(spark))
    counted = qc.missing_percent(df.toDF("a", "b", "c", "d"))
    assert sorted(map(tuple, known.collect())) == sorted(map(tuple, counted.select(known.columns).collect()))
    assert qc.missing_at_fit(df.withColumn("b", F.col("a").cast("binary")), plan.conversion(spark)) is None


def test_rows_made_distinct_are_not_grouped_again(spark):
    raw = claims(spark, SF)
    for options, again in ((CleanOptions(as_of=AS_OF), False), (CleanOptions(as_of=AS_OF, remove_duplicates=False), True)):
        plan = fit(raw, options, hints=CLAIMS_HINTS, exclude=("row_id",))
        rows = plan.clean(raw)
        found = duplicates_left(plan, rows)
        assert found.first()["duplicate_rate"] == dedup.duplicate_rate(rows).first()["duplicate_rate"]
        assert ("_copies" in plan_text(found)) == again
