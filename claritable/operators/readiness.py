"""Retrieval readiness: eight weighted checks per dataset, from the profile or the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claritable import rules
from claritable.functions.names import any_token
from claritable.functions.scoring import at_least, band, clamp, points, ratio, status_rank, whole_score
from claritable.operators.cells import COLUMN, DATASET

CHECK = "check_id"


def _checks(metrics: DataFrame, specs, stage: str) -> DataFrame:
    """One row per dataset and check from a row of metrics named after the checks."""
    entries = [F.struct(F.lit(i).alias("check_order"), F.lit(check).alias(CHECK),
                        F.lit(label).alias("label"), F.col(check).cast("double").alias("raw_metric"),
                        F.lit(weight).alias("weight"), F.lit(pass_min).alias("pass_min"),
                        F.lit(warn_min).alias("warn_min"), F.lit(advice).alias("recommendation"))
               for i, (check, label, weight, pass_min, warn_min, advice) in enumerate(specs)]
    rows = metrics.select(DATASET, F.lit(stage).alias("stage"), F.inline(F.array(*entries)))
    status = at_least(F.col("raw_metric"), F.col("pass_min"), F.col("warn_min"))
    return (
        rows.withColumn("status", status)
        .withColumn("metric", F.bround(clamp(F.col("raw_metric")), 3))
        .withColumn("severity", F.when(F.col("status") == "fail", "high")
                    .when(F.col("status") == "warn", "medium").otherwise("low"))
        .drop("raw_metric")
    )


def _flag(condition: Column) -> Column:
    return F.max(F.when(condition, 1).otherwise(0))


def profile_checks(profile: DataFrame, privacy_mode: str = "none") -> DataFrame:
    """Checks estimated from the column profile."""
    named = F.concat_ws(" ", "semantic_hint", "clean_name")
    tagged = F.size("domain_tags") > 0
    known = F.coalesce("primitive_type", F.lit("unknown")) != "unknown"
    textual = (F.col("primitive_type") == "string") & ~F.coalesce(
        F.col("semantic_hint").isin(*rules.NON_TEXT_HINTS), F.lit(False))
    lengths = F.aggregate("example_values", F.lit(0), lambda total, x: total + F.length(x))
    average = ratio(lengths, F.size("example_values"))
    dense = (F.col("missing_pct") < 60) & (F.col("distinct_count") > 5) & (average >= 15)
    chunkable = average.between(40, 450) & (F.col("missing_pct") < 65)
    target = F.coalesce(F.col("semantic_hint").isin(*rules.NORMALIZED_HINTS), F.lit(False)) | tagged
    pii_total = F.col("pii_email") + F.col("pii_phone") + F.col("pii_ssn")

    width = F.count(F.lit(1))
    share = lambda condition: F.count_if(condition) / width
    texts, targets = F.count_if(textual), F.count_if(target)
    pii_weight = 0.25 if privacy_mode == "safe_harbor" else 1.2
    metrics = profile.groupBy(DATASET).agg(
        ((_flag(any_token(named, rules.KEY_ID_TOKENS)) + _flag(any_token(named, rules.KEY_DATE_TOKENS))
          + _flag(tagged | any_token(named, rules.KEY_CODE_TOKENS))) / 3).alias("key_fields_presence"),
        ratio(F.count_if(textual & dense), texts).alias("text_density"),
        ratio(F.count_if(textual & chunkable), texts).alias("chunkable_text_quality"),
        (1 - share(F.col("missing_pct") > rules.HIGH_MISSING_PCT)).alias("missingness_health"),
        (1 - share(F.col("distinct_count") <= 1)).alias("dedup_health"),
        F.when(targets > 0, F.count_if(target & known) / targets).otherwise(F.lit(1.0))
        .alias("normalization_health"),
        clamp(1 - share(pii_total > 0) * pii_weight).alias("pii_safety"),
        share(known).alias("schema_clarity"),
    )
    return _checks(metrics, rules.PROFILE_CHECKS, "before")


def data_metrics(metrics: DataFrame, duplicates: DataFrame, invalid: DataFrame,
                 privacy_mode: str = "none") -> DataFrame:
    """The eight check metrics per dataset from column metrics (``qc.column_metrics``).

    ``duplicates`` has ``duplicate_rate``, ``invalid`` has ``invalid_total`` and
    ``tracked_columns`` per dataset.
    """
    name = F.col(COLUMN)
    has = lambda tokens: any_token(name, tokens)
    textual = F.col("is_text") & ~has(rules.NON_TEXT_NAME_TOKENS)
    filled = F.col("non_blank") / F.col("non_null")
    average = F.col("total_length") / F.col("non_null")
    any_value = F.col("non_null") > 0
    pii_named = has(rules.PII_NAME_TOKENS)
    hits = F.when(pii_named, F.col("row_count")).otherwise(
        F.col("pii_email") + F.col("pii_phone") + F.col("pii_ssn"))
    width = F.count(F.lit(1))
    texts = F.count_if(textual)
    base = metrics.groupBy(DATASET).agg(
        F.max("row_count").alias("row_count"), width.alias("column_count"),
        ((_flag(name.rlike(r"(?i)_id$|member_id|patient_id")) + _flag(has(("date", "dob")))
          + _flag(has(rules.CODE_NAME_TOKENS))) / 3).alias("key_fields_presence"),
        ratio(F.count_if(textual & any_value & (filled >= 0.70)), texts).alias("text_density"),
        ratio(F.count_if(textual & any_value & average.between(40, 500) & (filled >= 0.50)), texts)
        .alias("chunkable_text_quality"),
        clamp(1 - F.avg("missing_pct") / 100).alias("missingness_health"),
        F.sum(hits).alias("pii_hits"),
        (F.count_if(F.lower(name).rlike(r"^[a-z0-9_]+$")) / width).alias("schema_clarity"),
    )
    rows = F.greatest(F.col("row_count"), F.lit(1))
    tracked = F.greatest(F.coalesce("tracked_columns", F.lit(0)), F.lit(1))
    leak = clamp(F.col("pii_hits") / (rows * F.greatest(F.col("column_count"), F.lit(1))))
    factor = 0.5 if privacy_mode == "safe_harbor" else 1.4
    return (
        base.join(duplicates.select(DATASET, "duplicate_rate"), DATASET, "left")
        .join(invalid.select(DATASET, "invalid_total", "tracked_columns"), DATASET, "left")
        .withColumns({
            "dedup_health": clamp(1 - F.coalesce("duplicate_rate", F.lit(0.0))),
            "normalization_health": clamp(1 - F.coalesce("invalid_total", F.lit(0)) / (rows * tracked)),
            "pii_safety": clamp(1 - leak * factor),
        })
    )


def data_checks(metrics: DataFrame, duplicates: DataFrame, invalid: DataFrame,
                privacy_mode: str = "none") -> DataFrame:
    """Checks measured on cleaned rows."""
    return _checks(data_metrics(metrics, duplicates, invalid, privacy_mode), rules.DATA_CHECKS, "after")


def readiness_score(checks: DataFrame) -> DataFrame:
    """Weighted score and band per dataset."""
    status = F.col("status")
    scored = checks.groupBy(DATASET).agg(
        # Hundredths are summed as whole numbers: the order of rows cannot move the result.
        F.sum(F.round(points(status) * F.col("weight") * 1000).cast("bigint")).alias("_thousandths"),
        F.count_if(status == "fail").alias("failed_checks"),
        F.count_if(status == "warn").alias("warning_checks"),
    )
    summary = F.concat(
        F.col("failed_checks").cast("string"), F.lit(" checks failed and "),
        F.col("warning_checks").cast("string"),
        F.lit(" gave a warning; failed ones cost most points."))
    return (
        scored.withColumn("readiness_score", whole_score(F.col("_thousandths") / 10))
        .withColumn("readiness_band", band(F.col("readiness_score"), rules.READINESS_BANDS, "not_ready"))
        .withColumn("summary", summary).drop("_thousandths")
    )


def compare_checks(before: DataFrame, after: DataFrame) -> DataFrame:
    """Change of every check that either side has."""
    pick = lambda df, side: df.select(
        DATASET, CHECK, *[F.col(c).alias(f"{c}_{side}")
                          for c in ("check_order", "label", "status", "metric", "recommendation")])
    joined = pick(before, "b").join(pick(after, "a"), [DATASET, CHECK], "full_outer")
    old = F.lower(F.coalesce("status_b", F.lit("fail")))
    new = F.lower(F.coalesce("status_a", F.lit("fail")))
    change = (F.when(status_rank(new) > status_rank(old), "improved")
              .when(status_rank(new) < status_rank(old), "regressed").otherwise("unchanged"))
    compared = joined.select(
        DATASET, CHECK, F.coalesce("label_a", "label_b", CHECK).alias("label"),
        F.coalesce("check_order_a", F.col("check_order_b") + 1000).alias("check_order"),
        old.alias("status_before"), new.alias("status_after"), change.alias("status_delta"),
        F.bround("metric_b", 3).alias("metric_before"), F.bround("metric_a", 3).alias("metric_after"),
        F.bround(F.col("metric_a") - F.col("metric_b"), 3).alias("metric_delta"),
        F.coalesce(F.nullif("recommendation_a", F.lit("")), "recommendation_b", F.lit(""))
        .alias("recommended_action"),
    )
    return compared.withColumn(
        "priority",
        F.when((F.col("status_delta") == "regressed") | (F.col("status_after") == "fail"), "high")
        .when(F.col("status_after") == "warn", "medium").otherwise("low"))


def priority_actions(compared: DataFrame) -> DataFrame:
    """High and medium actions in working order, at most one per check."""
    order = W.partitionBy(DATASET).orderBy(
        F.when(F.col("priority") == "high", 0).otherwise(1),
        F.when(F.col("status_delta") == "regressed", 0).otherwise(1),
        status_rank(F.col("status_after")), F.coalesce("metric_after", F.lit(1.0)), "check_order")
    reason = (F.when(F.col("status_delta") == "regressed", "Worse than before")
              .when(F.col("status_after") == "fail", "Fails still")
              .otherwise("Warns still"))
    return (
        compared.filter(F.col("priority").isin("high", "medium"))
        .select(DATASET, F.row_number().over(order).alias("action_rank"), CHECK, "label", "priority",
                reason.alias("reason"), F.col("recommended_action").alias("action"))
    )


def comparison_summary(compared: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Counts of improved, regressed and unchanged checks with both scores.

    ``before`` and ``after`` are ``readiness_score`` outputs.
    """
    delta = F.col("status_delta")
    counts = compared.groupBy(DATASET).agg(
        F.count_if(delta == "improved").alias("improved"),
        F.count_if(delta == "regressed").alias("regressed"),
        F.count_if(delta == "unchanged").alias("unchanged"),
        F.count_if(F.col("priority") == "high").alias("high_priority"), F.count(F.lit(1)).alias("checks"))
    side = lambda df, name: df.select(DATASET, F.col("readiness_score").alias(f"score_{name}"),
                                      F.col("readiness_band").alias(f"band_{name}"))
    text = F.concat(F.col("improved").cast("string"), F.lit("/"), F.col("checks").cast("string"),
                    F.lit(" checks got better, "), F.col("regressed").cast("string"), F.lit(" worse, "),
                    F.col("unchanged").cast("string"), F.lit(" stayed the same; "),
                    F.col("high_priority").cast("string"), F.lit(" actions are urgent."))
    return (
        counts.join(side(before, "before"), DATASET, "left").join(side(after, "after"), DATASET, "left")
        .withColumns({"score_delta": F.col("score_after") - F.col("score_before"), "summary": text})
    )


def top_blockers(checks: DataFrame, limit: int = 5) -> DataFrame:
    """Failed checks before warned ones, lowest metric first."""
    order = W.partitionBy(DATASET).orderBy(
        F.when(F.col("status") == "fail", 0).otherwise(1), F.coalesce("metric", F.lit(1.0)), "check_order")
    return (
        checks.filter(F.col("status").isin("fail", "warn"))
        .withColumn("blocker_rank", F.row_number().over(order)).filter(F.col("blocker_rank") <= limit)
        .select(DATASET, "blocker_rank", CHECK, "label", "status", "metric", "recommendation")
    )


def score_delta(after: DataFrame, before: DataFrame) -> DataFrame:
    """Score measured on the data minus the score estimated from the profile."""
    return after.select(DATASET, "readiness_score").join(
        before.select(DATASET, F.col("readiness_score").alias("profile_score")), DATASET, "left"
    ).withColumn("delta_from_profile_score", F.col("readiness_score") - F.col("profile_score"))
