"""Cleaning, privacy and date handling on small tables with known results."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from claritable import CleaningPlan, CleanOptions, fit
from claritable.functions import coerce, names, pii, text
from claritable.operators import dedup, privacy, validate
from claritable.operators.profile import profile_columns

AS_OF = dt.date(2026, 6, 1)


def strings(spark, columns, rows):
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.createDataFrame(rows, schema)


def test_basic_clean_renames_drops_and_deduplicates(spark):
    raw = strings(spark, ["Patient ID", "DOB", "Charge ($)", "ICD Code", "Empty"], [
        ("001", "1/2/1980", "1,200.50", "a10", ""), ("001", "1/2/1980", "1,200.50", "a10", ""),
        ("002", "1985-03-04", "900", "b20", "")])
    hints = {"patient_id": ("string", "id"), "dob": ("date", "date"), "charge": ("number", None),
             "icd_code": ("string", "code")}
    plan = fit(raw, CleanOptions(as_of=AS_OF), hints=hints)
    rows = {r["patient_id"]: r for r in plan.clean(raw).collect()}
    assert len(rows) == 2 and plan.empty_columns == ["empty"]
    assert rows["001"].asDict() == {"patient_id": "001", "dob": dt.date(1980, 1, 2), "charge": 1200.5,
                                    "icd_code": "A10"}


def test_mixed_dates_keep_unparsed_text_in_safe_mode(spark):
    raw = strings(spark, ["encounter_date"], [
        ("2026-01-01T12:00:00Z",), ("2026-01-02 08:30:00",), ("bad-date",)])
    plan = fit(raw, CleanOptions(as_of=AS_OF, remove_duplicates=False, drop_empty_columns=False),
               hints={"encounter_date": ("date", "encounter_date")})
    values = {r[0] for r in plan.clean(raw).collect()}
    assert values == {"2026-01-01", "2026-01-02", "bad-date"}
    assert plan.columns[0].target == "date" and plan.columns[0].invalid == 1


def test_profile_of_mixed_time_zones(spark):
    raw = strings(spark, ["Encounter Date"], [
        ("2026-01-01T12:00:00Z",), ("2026-01-02 08:30:00",), ("2026-01-03T04:00:00-0500",), ("bad-date",)])
    row = profile_columns(raw, as_of=AS_OF).collect()[0]
    assert row["primitive_type"] == "date"
    assert (row["date_min"], row["date_max"]) == (dt.date(2026, 1, 1), dt.date(2026, 1, 3))


def test_safe_harbor_labels_and_generalized_dates(spark):
    raw = strings(spark, ["DOB", "Email", "Phone", "Zip", "Name"], [
        ("1980-01-15", "alice@example.com", "312-555-1212", "60601", "Alice Doe"),
        ("1910-05-02", "bob@example.com", "773-555-9999", "02139", "Bob Smith")])
    hints = {"dob": ("date", "dob"), "email": ("string", "email"), "phone": ("string", "phone"),
             "zip": ("string", "postal_code"), "name": ("string", "name")}
    plan = fit(raw, CleanOptions(as_of=AS_OF, privacy="safe_harbor", remove_duplicates=False), hints=hints)
    first, second = sorted(plan.clean(raw).collect(), key=lambda r: r["dob"])
    assert first["dob"] == "1980" and second["dob"] == "90+"
    assert first.asDict() == {"dob": "1980", "email": "[redacted_email]", "phone": "[redacted_phone]",
                              "zip": "60600", "name": "[redacted_name]"}


def test_future_dates_and_severity(spark):
    rows = [("2099-01-01", "-1", "INVALID")] + [("1980-01-01", "-1", "INVALID")] * 3 + [
        ("1980-01-01", "100", "A123")] * 96
    df = strings(spark, ["dob", "paid_amount", "icd_code"], rows)
    found = {r["issue_type"]: r for r in validate.issues(df, {"dob": "dob", "icd_code": "code"}, AS_OF).collect()}
    assert found["dob_future"]["severity"] == "high"
    assert found["negative_amount"]["severity"] == "low"
    assert found["invalid_icd10"]["severity"] == "medium" and found["invalid_icd10"]["rate_pct"] == 4.0


def test_future_dates_with_offsets(spark):
    soon = (dt.datetime(2026, 6, 1) + dt.timedelta(days=5)).isoformat() + "+00:00"
    later = (dt.datetime(2026, 6, 1) + dt.timedelta(days=30)).isoformat() + "+00:00"
    df = strings(spark, ["encounter_date", "dob"], [(soon, "1980-01-01"), ("2020-01-01 08:30:00", later)])
    found = {r["issue_type"]: r["count"] for r in validate.issues(
        df, {"encounter_date": "encounter_date", "dob": "dob"}, AS_OF).collect()}
    assert found == {"date_future": 1, "dob_future": 1}


@pytest.mark.parametrize("value,expected", [
    ("1/2/1980", "1980-01-02"), ("13/01/2023", "2023-01-13"), ("07-08-79", "1979-07-08"),
    ("12-31-30", "2030-12-31"), ("03-Feb-2023T08:30:00Z", "2023-02-03"), ("3-Feb-23 08:30:00", "2023-02-03"),
    ("Feb 3, 2024", "2024-02-03"), ("2024/01/15", "2024-01-15"), ("20230115", "2023-01-15"),
    ("2139", None), ("02139", None), ("12:30", None), ("99/99/9999", None), ("13-13-2013", None)])
def test_date_readings(spark, value, expected):
    got = spark.range(1).select(coerce.date_to_text(coerce.date(F.lit(value), dt.date(2024, 1, 1)))).collect()[0][0]
    assert got == expected


@pytest.mark.parametrize("value,expected", [
    ("$1,200.50", "1200.5"), ("(12.25)", "-12.25"), (" 900 ", "900"), ("3%", "3"), ("12 USD", None),
    ("12d", None), ("inf", None), ("12345678901", "12345678901"), ("1e5", "100000")])
def test_number_readings(spark, value, expected):
    got = spark.range(1).select(coerce.number_to_text(coerce.number(F.lit(value)))).collect()[0][0]
    assert got == expected


def test_missing_tokens_ignore_case_and_any_whitespace(spark):
    values = ["N/A", " unknown\t", "?", "-", "", " None ", "ok", " na x"]
    df = strings(spark, ["v"], [(v,) for v in values])
    kept = [r[0] for r in df.select(text.normalize_missing(F.col("v"))).collect()]
    assert kept == [None] * 6 + ["ok", " na x"]


def test_unique_names_keep_counting():
    assert names.standardize(["a", "A ", "a_2", "###", "", "E-mail"]) == [
        "a", "a_2", "a_2_2", "column", "column_2", "e_mail"]
    assert names.hint_for("provider") == "id" and names.hint_for("provider", "token") == "provider"


def test_redaction_leaves_no_detector_match(spark):
    df = strings(spark, ["t"], [("a.b@c.org 312-555-1212 123-45-6789",), ("3125551212 and 123456789",), (None,)])
    out = df.select(pii.redact(F.col("t")).alias("t"))
    hits = out.filter(pii.has_email(F.col("t")) | pii.has_phone(F.col("t")) | pii.has_ssn(F.col("t"))).count()
    assert hits == 0


def test_strict_mode_nulls_what_safe_mode_keeps(spark):
    df = strings(spark, ["amount", "dob"], [("1", "bad"), ("2", "2020-01-01"), ("x", "2020-01-02")])
    hints = {"amount": ("number", None), "dob": ("date", "dob")}
    strict = fit(df, CleanOptions(as_of=AS_OF, coercion="strict"), hints=hints).clean(df)
    assert dict(strict.dtypes) == {"amount": "double", "dob": "string"}
    assert {r["amount"] for r in strict.collect()} == {1.0, 2.0, None}
    safe = fit(df, CleanOptions(as_of=AS_OF), hints=hints).clean(df)
    assert {r["amount"] for r in safe.collect()} == {"1", "2", "x"}


def test_gate_keeps_text_below_sixty_percent(spark):
    df = strings(spark, ["amount"], [("1",), ("x",), ("y  z",)])
    plan = fit(df, CleanOptions(as_of=AS_OF), hints={"amount": ("number", None)})
    assert plan.columns[0].skipped and plan.columns[0].target == "string"
    assert {r[0] for r in plan.clean(df).collect()} == {"1", "x", "y z"}


def test_plan_survives_json_and_is_idempotent(spark):
    df = strings(spark, ["Phone", "Notes"], [("312-555-1212", " a   b "), ("?", "c")])
    plan = fit(df, CleanOptions(as_of=AS_OF))
    again = CleaningPlan.from_json(plan.to_json())
    assert again == plan
    once = plan.clean(df)
    assert sorted(fit(once, CleanOptions(as_of=AS_OF)).clean(once).collect(), key=str) == sorted(
        once.collect(), key=str)


def test_empty_table_keeps_its_schema(spark):
    df = strings(spark, ["a", "b"], [])
    plan = fit(df, CleanOptions(as_of=AS_OF), hints={})
    assert plan.clean(df).columns == ["a", "b"] and plan.empty_columns == []


def test_first_copy_stays_whatever_the_partitioning(spark):
    df = spark.range(0, 3000).select(F.col("id"), (F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7)).alias("k"))
    for n in (1, 5, 32):
        kept = dedup.drop_duplicates(df.repartition(n), keep_first="id").collect()
        assert sorted((r["id"], r["k"]) for r in kept) == [(0, 0), (1, 1), (2, 2), (4, 4), (5, 5), (10, 3), (13, 6)]


def test_masks_cover_null_rows_and_count_in_metrics(spark):
    from claritable.operators.qc import column_metrics
    df = strings(spark, ["email", "notes"], [(None, "x"), ("a@b.org", None)])
    masked = privacy.safe_harbor(df, {}, AS_OF)
    assert {r["email"] for r in masked.collect()} == {"[redacted_email]"}
    rows = {r["column_name"]: r["non_null"] for r in column_metrics(masked).collect()}
    assert rows == {"email": 2, "notes": 1}
