"""Clean a table and raise its readiness score toward a target.

The driver walks at most five steps.  Scoring a candidate reads one row per column from
the metrics of the materialized table; only a new text column or a new duplicate rate
scans rows again.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claritable import rules
from claritable.operators import dedup, qc, readiness, retrieval
from claritable.operators.cells import COLUMN, DATASET
from claritable.options import CleanOptions
from claritable.plans.cleaning import CleaningPlan, fit
from claritable.sources.scratch import materialize


@dataclass
class Candidate:
    """A version of the table with its metrics and score."""

    df: DataFrame
    metrics: DataFrame
    score: int
    checks: DataFrame


@dataclass
class Optimization:
    table: DataFrame
    checks: DataFrame
    target_score: int
    final_score: int
    baseline_score: int
    actions: list[str] = field(default_factory=list)

    @property
    def target_met(self) -> bool:
        return self.final_score >= self.target_score

    def report(self, spark: SparkSession, dataset: str) -> DataFrame:
        return spark.createDataFrame(
            [(dataset, self.target_score, self.final_score, self.target_met,
              "on_track" if self.target_met else "needs_attention", self.actions)],
            "dataset_id string, target_score int, achieved_score int, target_met boolean, "
            "status string, actions array<string>")


class Optimizer:
    """Greedy steps; each is kept only when the score does not fall."""

    def __init__(self, df: DataFrame, plan: CleaningPlan, row_id: str, target_score: int):
        self.plan, self.row_id, self.target = plan, row_id, target_score
        self.privacy = plan.options.privacy
        self.spark = df.sparkSession
        self.actions: list[str] = []
        self.current = self._candidate(df)
        self.baseline = self.current.score

    def _candidate(self, df: DataFrame, metrics: DataFrame | None = None) -> Candidate:
        if metrics is None:
            metrics = qc.column_metrics(df, dataset=self.plan.dataset, exclude=(self.row_id,))
            # One row per column: kept on the driver side of later scoring.
            metrics = self.spark.createDataFrame(metrics.collect(), metrics.schema)
        columns = [c for c in df.columns if c != self.row_id]
        repeated = dedup.duplicate_rate(df, columns=columns).withColumn(DATASET, F.lit(self.plan.dataset))
        tracked = {c: n for c, n in self.plan.invalid_values.items() if c in columns}
        if retrieval.CONTEXT in columns:
            tracked.setdefault(retrieval.CONTEXT, 0)
        invalid = self.spark.createDataFrame(
            [(self.plan.dataset, sum(tracked.values()), len(tracked))],
            "dataset_id string, invalid_total bigint, tracked_columns bigint")
        checks = readiness.data_checks(metrics, repeated, invalid, self.privacy)
        rows = self.spark.createDataFrame(checks.collect(), checks.schema)
        score = readiness.readiness_score(rows).collect()[0]["readiness_score"]
        return Candidate(df, metrics, score, rows)

    def _try(self, candidate: Candidate, *actions: str) -> None:
        if candidate.score >= self.current.score:
            self.current = candidate
            self.actions += actions

    def _without(self, columns: list[str]) -> Candidate:
        kept = self.current.metrics.filter(~F.col(COLUMN).isin(*columns))
        return self._candidate(self.current.df.drop(*columns), kept)

    def add_context(self) -> None:
        candidates = retrieval.text_candidates(self.current.metrics)
        if not candidates.filter(retrieval.is_chunkable()).isEmpty():
            return
        # A summary beside the table's own columns, which keep all of the text.
        chosen = retrieval.context_columns(self.current.df, (self.row_id,), limit=rules.SUMMARY_COLUMNS)
        action = (f"Wrote rag_context from {', '.join(chosen)}." if chosen else
                  "Wrote rag_context from row numbers.")
        self._try(self._candidate(retrieval.with_context(
            self.current.df, self.row_id, chosen, max_chars=rules.CHUNK_CHARS)), action)

    def drop_low_signal(self) -> None:
        weak = [r[COLUMN] for r in retrieval.low_signal_columns(self.current.metrics).collect()]
        if weak:
            self._try(self._without(weak),
                      f"Left out {len(weak)} text columns that say little.")

    def drop_high_missing(self) -> None:
        sparse = [r[COLUMN] for r in retrieval.high_missing_columns(self.current.metrics).collect()]
        if sparse:
            self._try(self._without(sparse),
                      f"Left out {len(sparse)} columns that are nearly empty.")

    def drop_pii_named(self) -> None:
        named = retrieval.pii_named_columns(c for c in self.current.df.columns if c != self.row_id)
        if named:
            self._try(self._without(named),
                      f"Left out {len(named)} columns named after personal data.")

    def project(self) -> None:
        projected = retrieval.chunked(retrieval.retrieval_projection(
            self.current.df, self.row_id, self.plan.options.as_of))
        # The projection has its own ids; the row key stays out of it.
        self._try(self._candidate(projected),
                  "Wrote rag_context without personal data.",
                  "Kept only record, date, code and text of each row.")

    def run(self) -> Optimization:
        self.add_context()
        for step in (self.drop_low_signal, self.drop_high_missing, self.drop_pii_named, self.project):
            if self.current.score >= self.target:
                break
            step()
        return Optimization(self.current.df, self.current.checks, self.target, self.current.score,
                            self.baseline, self.actions)


def autopilot_options(usage_intent: str = "training", **changes) -> CleanOptions:
    """Defaults by use: Safe Harbor for training and external sharing, none otherwise."""
    shared = usage_intent in ("training", "external_share")
    options = CleanOptions(deidentify=shared, privacy="safe_harbor" if shared else "none")
    return replace(options, **changes).resolved()


def autopilot(df: DataFrame, row_id: str, options: CleanOptions, *, target_score: int = 80,
              dataset: str = "dataset", hints=None) -> tuple[CleaningPlan, Optimization]:
    """Fit, clean, materialize once, then optimize the cleaned table."""
    plan = fit(df, options, hints=hints, exclude=(row_id,), dataset=dataset)
    cleaned = materialize(plan.clean(df, row_id), "autopilot")
    return plan, Optimizer(cleaned, plan, row_id, target_score).run()
