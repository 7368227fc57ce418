"""Scores, comparisons and gates on hand-made report rows."""

import pytest
from pyspark.sql import functions as F

from claritable.operators import assess, outcomes, qc, readiness, validate


def profile_rows(spark, width, missing, variance, pii, unknown):
    rows = [("d", i, f"c{i}", 50.0 if i < missing else 0.0, 1 if i < variance else 9, 1 if i < pii else 0, 0, 0,
             "unknown" if i < unknown else "string") for i in range(width)]
    return spark.createDataFrame(rows, (
        "dataset_id string, position int, clean_name string, missing_pct double, distinct_count bigint, "
        "pii_email bigint, pii_phone bigint, pii_ssn bigint, primitive_type string"))


@pytest.mark.parametrize("flags,score,band", [
    ((0, 0, 0, 0), 100, "excellent"), ((3, 2, 2, 6), 70, "good"), ((8, 7, 6, 8), None, "poor")])
def test_assessment_bands(spark, flags, score, band):
    row = assess.assessment(assess.column_counts(profile_rows(spark, 10, *flags))).collect()[0]
    assert row["assessment_band"] == band
    assert row["assessment_score"] == score if score is not None else row["assessment_score"] < 50


def test_readiness_of_a_described_profile(spark):
    rows = [
        ("patient_id", "string", "id", 0.0, 100, ["p1"], []),
        ("encounter_date", "date", "encounter_date", 0.0, 90, ["2024-01-01"], []),
        ("icd_code", "string", "code", 1.0, 30, ["A12.3"], ["icd"]),
        ("clinical_note", "string", None, 5.0, 80, ["Patient presents with persistent cough and fatigue."], []),
        ("plan_text", "string", None, 10.0, 60,
         ["Recommend hydration, follow-up in two weeks, and medication review."], []),
        ("provider_name", "string", "provider", 2.0, 30, ["Dr Smith"], [])]
    df = spark.createDataFrame(rows, (
        "clean_name string, primitive_type string, semantic_hint string, missing_pct double, "
        "distinct_count bigint, example_values array<string>, domain_tags array<string>")).withColumns(
        {"dataset_id": F.lit("d"), **{c: F.lit(0) for c in ("pii_email", "pii_phone", "pii_ssn")}})
    checks = readiness.profile_checks(df, "safe_harbor")
    assert checks.count() == 8
    row = readiness.readiness_score(checks).collect()[0]
    assert row["readiness_score"] >= 60 and row["readiness_band"] in ("ready", "partial")


def checks(spark, rows):
    full = [("d", i, *r, f"do {r[0]}") for i, r in enumerate(rows)]
    return spark.createDataFrame(full, (
        "dataset_id string, check_order int, check_id string, label string, status string, metric double, "
        "recommendation string"))


def test_comparison_marks_changes_and_orders_actions(spark):
    before = checks(spark, [("text_density", "Text Density", "warn", 0.31), ("pii_safety", "PII Safety", "warn", 0.72),
                            ("schema_clarity", "Schema Clarity", "pass", 0.9)])
    after = checks(spark, [("text_density", "Text Density", "pass", 0.52), ("pii_safety", "PII Safety", "fail", 0.48),
                           ("schema_clarity", "Schema Clarity", "pass", 0.95)])
    compared = readiness.compare_checks(before, after)
    rows = {r["check_id"]: r for r in compared.collect()}
    assert rows["text_density"]["status_delta"] == "improved"
    assert rows["pii_safety"]["status_delta"] == "regressed" and rows["pii_safety"]["priority"] == "high"
    assert rows["schema_clarity"]["status_delta"] == "unchanged"
    assert rows["pii_safety"]["metric_delta"] == -0.24
    first = readiness.priority_actions(compared).orderBy("action_rank").first()
    assert first["check_id"] == "pii_safety" and first["reason"] == "Worse than before"


def facts(spark, **changes):
    row = dict(dataset_id="d", missing_raw=1.0, missing_cleaned=1.0, invalid_total=0, tracked_columns=1,
               row_count_cleaned=100, duplicate_rows_removed=0, high_issues=0, pii_status="pass", score_before=80,
               score_after=90, duration_ms=60_000)
    row.update(changes)
    return spark.createDataFrame([row], (
        "dataset_id string, missing_raw double, missing_cleaned double, invalid_total bigint, tracked_columns bigint, "
        "row_count_cleaned bigint, duplicate_rows_removed bigint, high_issues bigint, pii_status string, "
        "score_before int, score_after int, duration_ms bigint"))


def gate(rows):
    return outcomes.quality_gate(rows).collect()[0]


def test_gate_fails_on_critical_outcomes(spark):
    rows = outcomes.evaluate(facts(spark, missing_cleaned=25.0, invalid_total=20, row_count_cleaned=10, high_issues=2,
                                   pii_status="fail", score_before=85, score_after=40, duration_ms=600_000))
    result = gate(rows)
    assert result["gate_status"] == "fail" and "critical_date_integrity" in result["failed_outcomes"]
    decision = outcomes.release_decision(rows).collect()[0]
    assert decision["blockers"] and "Do not release" in decision["release_recommendation"]


def test_gate_warns_on_other_failures(spark):
    result = gate(outcomes.evaluate(facts(spark, invalid_total=20, row_count_cleaned=10)))
    assert result["gate_status"] == "warn" and result["failed_outcomes"] == ["invalid_value_reduction"]


def test_invalid_rate_counts_rows_and_columns(spark):
    rows = outcomes.evaluate(facts(spark, invalid_total=5, tracked_columns=5)).filter(
        F.col("outcome_id") == "invalid_value_reduction").collect()[0]
    assert float(rows["observed_value"]) == 1.0 and rows["status"] == "pass"


def test_dropping_readiness_is_not_passed(spark):
    rows = outcomes.evaluate(facts(spark, score_after=50), dedup_enabled=False).collect()
    found = {r["outcome_id"]: r["status"] for r in rows}
    assert found["rag_readiness_score"] == "fail" and found["duplicate_reduction"] == "warn"


def test_missing_tokens_count_before_and_after(spark):
    raw = spark.createDataFrame([("N/A",), ("?",), ("ok",), ("unknown",)], "notes string")
    cleaned = spark.createDataFrame([(None,), (None,), ("ok",), (None,)], "notes string")
    assert qc.missing_percent(raw).collect()[0]["missing_pct"] == 75.0
    assert qc.missing_percent(cleaned).collect()[0]["missing_pct"] == 75.0


def test_severity_counts(spark):
    rows = spark.createDataFrame([("d", "high"), ("d", "medium"), ("d", "low")], "dataset_id string, severity string")
    got = validate.severity_counts(rows).collect()[0]
    assert (got["high"], got["medium"], got["low"], got["total"]) == (1, 1, 1, 3)
