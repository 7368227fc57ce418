"""Whole runs over one table: pre-check, and clean with its reports."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claritable.operators import assess, dedup, outcomes, profile, qc, readiness, validate
from claritable.operators.cells import DATASET
from claritable.options import CleanOptions
from claritable.plans.cleaning import CleaningPlan, fit_and_clean
from claritable.sources.scratch import materialize


@dataclass
class Precheck:
    """Profile tables of one or many datasets."""

    columns: DataFrame
    datasets: DataFrame
    checks: DataFrame
    domains: DataFrame


def precheck(df: DataFrame, *, dataset="dataset", order_by=None, options: CleanOptions,
             exclude: tuple[str, ...] = (), save: bool = True) -> Precheck:
    """Profile, assess and decide; the column profile is the only pass over the rows."""
    columns = profile.profile_columns(df, dataset=dataset, order_by=order_by, as_of=options.as_of,
                                      exclude=exclude)
    if save:
        columns = materialize(columns, "profile")
    checks = readiness.profile_checks(columns, options.privacy)
    scores = readiness.readiness_score(checks).select(DATASET, "readiness_score", "readiness_band")
    domains = profile.detect_domains(columns)
    primary = domains.filter(F.col("domain_rank") == 1).select(DATASET, F.col("domain").alias("primary_domain"))
    counts = assess.assessment(assess.column_counts(columns))
    decided = assess.preclean_decision(counts.join(scores, DATASET), options.privacy)
    flags = profile.profile_flags(columns).drop("column_count")
    datasets = decided.join(primary, DATASET, "left").join(flags, DATASET, "left")
    return Precheck(columns, datasets, checks, domains)


@dataclass
class CleanRun:
    """A cleaned table and its report tables."""

    plan: CleaningPlan
    table: DataFrame
    columns: DataFrame
    issues: DataFrame
    checks: DataFrame
    score: DataFrame
    outcomes: DataFrame
    gate: DataFrame
    decision: DataFrame
    duration_ms: int


def invalid_totals(plan_columns: DataFrame) -> DataFrame:
    return plan_columns.groupBy(DATASET).agg(
        F.sum("invalid").alias("invalid_total"), F.count("invalid").alias("tracked_columns"))


def duplicates_left(plan: CleaningPlan, cleaned: DataFrame, exclude: tuple[str, ...] = (),
                    dataset: str = "dataset") -> DataFrame:
    """``duplicate_rate`` of a cleaned table; not counted where rows were just made distinct and no mask merged them since."""
    private = plan.options.deidentify or plan.options.privacy == "safe_harbor"
    if plan.options.remove_duplicates and not private:
        found = cleaned.limit(0).agg(F.lit(0.0).alias("duplicate_rate"))
    else:
        found = dedup.duplicate_rate(cleaned, columns=[c for c in cleaned.columns if c not in exclude])
    return found.withColumn(DATASET, F.lit(dataset))


def clean_run(df: DataFrame, *, dataset: str = "dataset", row_key: str | None = None,
              options: CleanOptions, hints=None, before: DataFrame | None = None,
              exclude: tuple[str, ...] = (), validate_stage: str = "pre_privacy") -> CleanRun:
    """Fit, clean, write once, then measure the written rows once for all reports.

    What the raw rows were missing is known from the fit. Reports are written too, so that those who read them do not
    measure again.

    ``exclude`` names columns that are no data, such as a row number; they are left out,
    while ``row_key`` is kept and breaks ties between repeated rows.

    ``before`` is the profile's readiness score.  ``validate_stage="post_privacy"``
    validates the masked output instead of the values it was made from.
    """
    started = time.monotonic()
    spark = df.sparkSession
    keys = (row_key,) if row_key else ()
    exclude = tuple(dict.fromkeys((*keys, *exclude)))
    plan, rows = fit_and_clean(df, options, hints=hints, exclude=exclude, dataset=dataset, row_key=row_key)
    table = plan.privatize(rows, keys)

    plan_columns = plan.conversion(spark)
    subject = table if validate_stage == "post_privacy" else rows
    empty = validate.rule_counts(subject, plan.hints, plan.options.as_of, dataset=dataset,
                                 exclude=exclude, only=() if not plan.options.validates else None)
    issues = materialize(validate.with_severity(empty.filter(F.col("count") > 0)), "issues")
    metrics = materialize(qc.column_metrics(table, dataset=dataset, exclude=exclude), "metrics")
    before_clean = qc.missing_at_fit(df, plan_columns, exclude) if plan.options.normalize_missing else None
    report = materialize(qc.qc_columns(df, table, plan_columns, dataset=dataset, exclude=exclude,
                                       before=before_clean, after=metrics), "report")
    accounting = qc.row_accounting(df, rows, plan_columns, dataset)
    repeated = duplicates_left(plan, table, exclude, dataset)
    checks = readiness.data_checks(metrics, repeated, invalid_totals(plan_columns), plan.options.privacy)
    checks = materialize(checks, "checks")
    score = readiness.readiness_score(checks)
    if before is None:
        before = score.select(DATASET, F.lit(None).cast("int").alias("readiness_score"))
    removed = accounting.select(DATASET, F.col("rows_removed").alias("duplicate_rows_removed"))
    facts = outcomes.run_facts(report, accounting, removed, issues, checks, score, before)
    duration = int((time.monotonic() - started) * 1000)
    results = materialize(outcomes.evaluate(
        facts.withColumn("duration_ms", F.lit(duration)), performance=plan.options.performance,
        dedup_enabled=plan.options.remove_duplicates), "outcomes")
    return CleanRun(plan, table, report, issues, checks, score, results,
                    outcomes.quality_gate(results), outcomes.release_decision(results), duration)
