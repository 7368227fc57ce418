"""Dataset scores from the column profile: assessment and the pre-clean decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claritable import rules
from claritable.functions.scoring import band, clamp, ratio, whole_score
from claritable.operators.cells import DATASET

_FACTOR_COUNTS = {
    "high_missing_columns_pct": "high_missing", "low_variance_columns_pct": "low_variance",
    "pii_suspected_columns_pct": "pii", "schema_uncertainty_pct": "unknown_schema",
}


def column_counts(profile: DataFrame) -> DataFrame:
    """Flag counts per dataset that every score starts from."""
    pii_total = F.col("pii_email") + F.col("pii_phone") + F.col("pii_ssn")
    return profile.groupBy(DATASET).agg(
        F.count(F.lit(1)).alias("column_count"),
        F.count_if(F.col("missing_pct") > rules.HIGH_MISSING_PCT).alias("high_missing"),
        F.count_if(F.col("distinct_count") <= 1).alias("low_variance"),
        F.count_if(pii_total > 0).alias("pii"),
        F.count_if(F.coalesce("primitive_type", F.lit("unknown")) == "unknown").alias("unknown_schema"),
    )


def _share(factor: str) -> Column:
    return clamp(ratio(F.col(_FACTOR_COUNTS[factor]), F.col("column_count")))


def assessment(counts: DataFrame) -> DataFrame:
    """Score 0-100 and band per dataset."""
    penalty = F.lit(0.0)
    for factor, _, weight in rules.ASSESSMENT_FACTORS:
        penalty = penalty + _share(factor) * 100 * weight
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.lit(100.0) - penalty))
    return counts.withColumn("assessment_score", whole_score(score)).withColumn(
        "assessment_band", band(F.col("assessment_score"), rules.ASSESSMENT_BANDS, "poor"))


def assessment_factors(counts: DataFrame) -> DataFrame:
    """One row per factor: affected share, weight and penalty."""
    entries = [F.struct(F.lit(factor).alias("factor"), F.lit(label).alias("label"),
                        F.bround(_share(factor) * 100, 2).alias("value_pct"),
                        F.lit(weight).alias("weight"),
                        F.bround(_share(factor) * 100 * weight, 2).alias("penalty"))
               for factor, label, weight in rules.ASSESSMENT_FACTORS]
    return counts.select(DATASET, F.inline(F.array(*entries)))


def _text(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def preclean_decision(scored: DataFrame, privacy_mode: str = "none") -> DataFrame:
    """ready, needs_review or blocked, with reasons and actions.

    ``scored`` is ``assessment`` output joined with ``readiness_score``.
    """
    width = F.greatest(F.col("column_count"), F.lit(1))
    missing, found = F.col("high_missing"), F.col("pii")
    missing_share, pii_share = missing / width, found / width
    unsure = F.bround(_share("schema_uncertainty_pct") * 100, 2)
    score, ready = F.col("assessment_score"), F.col("readiness_score")
    unsafe = F.lit(privacy_mode != "safe_harbor")

    # (condition, severity, reason, action); of each pair only the first that holds counts.
    ladders = (
        ((score < 50, 2, _text("Only ", score, " of 100 points for quality."), "assessment_poor"),
         (score < 70, 1, _text(score, " of 100 points for quality; 70 are wanted."), "assessment_low")),
        ((missing_share >= 0.35, 2, _text(missing, " of ", width, " columns are mostly empty."), "missing_high"),
         (missing_share >= 0.15, 1, _text(missing, " columns have many empty cells."), "missing_some")),
        (((found > 0) & unsafe & (pii_share >= 0.3), 2,
          _text(found, " columns seem to hold personal data, and masking is off."), "pii_open"),
         (found > 0, 1, _text(found, " columns seem to hold personal data."), "pii_some")),
        ((unsure >= 35, 2, _text("Type or meaning is open for ", unsure, "% of the columns."), "schema_high"),
         (unsure >= 20, 1, _text(unsure, "% of the columns are not fully understood."), "schema_some")),
        ((ready < 55, 2, _text("Only ", ready, " of 100 points for retrieval."), "readiness_low"),
         (ready < 70, 1, _text(ready, " of 100 points for retrieval; 70 are wanted."), "readiness_some")),
    )
    levels, reasons, actions = [], [], []
    for (c1, s1, r1, a1), (c2, s2, r2, a2) in ladders:
        levels.append(F.when(c1, s1).when(c2, s2).otherwise(0))
        reasons.append(F.when(c1, r1).when(c2, r2))
        actions.append(F.when(c1, F.lit(rules.PRECLEAN_ACTIONS[a1]))
                       .when(c2, F.lit(rules.PRECLEAN_ACTIONS[a2])))
    severity = F.greatest(*levels)
    unique = lambda items: F.array_distinct(F.array_compact(F.array(*items)))
    return scored.withColumns({
        "decision": F.when(severity == 0, "ready").when(severity == 1, "needs_review").otherwise("blocked"),
        "reasons": F.when(severity == 0, F.array(F.lit(rules.READY_REASON))).otherwise(unique(reasons)),
        "actions": F.when(severity == 0, F.array(F.lit(rules.READY_ACTION))).otherwise(unique(actions)),
    })
