"""A run settles raw rows once, with the plan and the rows of a fit and a clean of their own."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from claritable.functions import coerce, pii
from claritable.operators import dedup, qc
from claritable.options import CleanOptions
from claritable.plans import cleaning
from claritable.plans.runs import clean_run
from workload.cleaning import CLAIMS_HINTS
from workload.inputs import AS_OF, claims

SF = "/root/testdata/sf0.001"
NUMBERS = ["7", "7.0", " 7 ", " 7", "0", "-0", "-0.0", "1e999", "Infinity", "-1e999", "7 USD", "7  USD", "(7)", "$7,000.50", "5d", "5%",
           "12345678.125", "1e30", "1E-7", "٧", "", "N/A", None]
DATES = ["2024-01-02", "1/2/2024", " 2024/1/2", "0000-01-01", "0001-01-01", "9999-12-31T23:30:00-0500", "+10000-01-01", "pending",
         "pending ", "2024-01-02T23:30:00-0500", "2024-01-03", "?", None]
WHOLE = [x for x in NUMBERS if x in ("7", "7.0", " 7 ", "0", "-0", "-0.0", "(7)", "5%", "1E-7", "", None)]
BARE = ["true", "TRUE", "no", "maybe", "maybe ", " y", "y", "", None]
NDC = ["0002-8215-01", "NDC", "123", " 123", "?", None]


def table(spark, numbers, dates):
    rows = [(i, numbers[i % len(numbers)], dates[i % len(dates)], BARE[i % len(BARE)], NDC[i % len(NDC)], None) for i in range(400)]
    return spark.createDataFrame(rows + rows[:150], "k bigint, `Paid` string, `Service Date` string, flag string, ndc string, gone string")


HINTS = {"paid": ("number", None), "service_date": ("date", "encounter_date"), "flag": ("boolean", None), "ndc": ("string", "code")}
DAYS = ["2024-01-02", "1/2/2024", "2024/1/3", "13/2/2024", None]


def apart(df, options, row_key=None):
    keys = (row_key,) if row_key else ()
    plan = cleaning.fit(df, options, hints=HINTS, exclude=("k",))
    rows = plan.project(df, keys)
    return plan, dedup.drop_duplicates(rows, keep_first=row_key) if options.remove_duplicates else rows


@pytest.mark.parametrize("row_key", [None, "k"])
@pytest.mark.parametrize("changes", [{}, {"coercion": "strict"}, {"sanitize": False}, {"normalize_missing": False}, {"text_case": "upper"},
                                     {"remove_duplicates": False}, {"performance": "ultra_fast"}])
def test_plan_and_rows_are_those_of_a_fit_and_a_clean(spark, changes, row_key):
    options = CleanOptions(as_of=AS_OF, **changes)
    sides = [(NUMBERS, DATES), (WHOLE, DAYS)]
    if changes or row_key:
        sides = sides[:1]
    else:
        # Clean columns, a column that fails its gate, and an empty table.
        sides += [(["1", "2.50", "2.5", None], DAYS), (["x", "y", "1"], DAYS)]
    for numbers, dates in sides:
        df = table(spark, numbers, dates)
        plan, rows = cleaning.fit_and_clean(df, options, hints=HINTS, exclude=("k",), row_key=row_key)
        other, wanted = apart(df, options.resolved(), row_key)
        assert plan == other
        assert rows.dtypes == wanted.dtypes
        text = lambda d: sorted(map(str, (tuple(r) for r in d.collect())))
        assert text(rows) == text(wanted)


def test_empty_table(spark):
    df = table(spark, NUMBERS, DATES).limit(0)
    options = CleanOptions(as_of=AS_OF)
    plan, rows = cleaning.fit_and_clean(df, options, hints=HINTS, exclude=("k",))
    assert plan == apart(df, options)[0] and rows.count() == 0 and rows.dtypes == apart(df, options)[1].dtypes


def test_a_run_does_not_measure_raw_cells_on_their_own(spark, monkeypatch):
    def again(*_):
        raise AssertionError("raw cells are read again")

    monkeypatch.setattr(cleaning, "measure_conversion", again)
    monkeypatch.setattr(cleaning.CleaningPlan, "project", again)
    run = clean_run(claims(spark, SF), dataset="claims", options=CleanOptions(as_of=AS_OF), hints=CLAIMS_HINTS, exclude=("row_id",))
    assert run.table.count() == run.table.distinct().count()


def test_numbers_need_no_failed_cast(spark):
    v = F.col("v")
    bare = F.translate(v, "dDfFiInNxXpP,$%", "#" * 12)
    plain = F.when(F.contains(v, F.lit("(")), F.regexp_replace(bare, r"\(([^)]+)\)", "-$1")).otherwise(bare).try_cast("double")
    df = spark.createDataFrame([(x,) for x in [*NUMBERS, "7 ", "7\t", "(7", "7)", "7.", ".7", "1e", "1,", "7_", "0x1p3", "7é"]], "v string")
    for got, wanted, written in df.select(coerce.number(v), plain, coerce.number_to_text(plain)).collect():
        assert str(got) == str(wanted)
        assert written is None or not written.endswith(".0")


def test_phones_and_ssns_share_one_look(spark):
    texts = ["312-555-0123", "x 3125550123.", "123-45-6789", "123456789", "1234567890", "CLM-0000123", "2024-01-02", "54868588201",
             "a123-45-6789", "312 555.0123", "312 555 0123", "12-34", "", None]
    df = spark.createDataFrame([(x,) for x in texts], "v string")
    v = F.col("v")
    for r in df.select(v, pii.has_phone(v).alias("p"), pii.has_ssn(v).alias("s"), pii.may_have_number(v).alias("m")).collect():
        assert r.m or not (r.p or r.s), r.v
    found = qc.column_metrics(df).first()
    wanted = df.agg(F.count_if(pii.has_phone(v)).alias("p"), F.count_if(pii.has_ssn(v)).alias("s")).first()
    assert (found["pii_phone"], found["pii_ssn"]) == tuple(wanted)
