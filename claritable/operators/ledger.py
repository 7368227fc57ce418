"""Run ledger: an append-only event table and the history queries over it.

A run appends one row per status change.  Its current state is the latest event, found
with an aggregate that each task begins on its own rows, so history length never
concentrates in one task.  Events lie in folders by a hash of the dataset: the runs of one dataset are
read from one of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claritable import rules

SCHEMA = (
    "dataset_id string, run_id string, event_time timestamp, status string, "
    "performance_mode string, privacy_mode string, output_format string, cleanup_mode string, "
    "started_at timestamp, completed_at timestamp, duration_ms bigint, gate_status string, "
    "decision string, readiness_score int, warnings array<string>, error string, "
    "outcomes array<struct<outcome_order:int,outcome_id:string,label:string,status:string,"
    "target:string,observed_value:string,unit:string,evidence:string,recommended_action:string>>")
BUCKETS = 16
FINAL = ("completed", "failed", "cancelled")


class RunLedger:
    """Parquet events partitioned by dataset bucket."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def append(self, events: DataFrame) -> None:
        """Append events; columns the events lack are NULL."""
        fields = self.spark.createDataFrame([], SCHEMA).schema
        full = events.select(*[
            (F.col(f.name) if f.name in events.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in fields])
        placed = full.withColumn("dataset_bucket", bucket(F.col("dataset_id")))
        # Rebalancing writes one file per folder, and splits a folder that is too large for one.
        placed.hint("rebalance", "dataset_bucket").write.mode("append").partitionBy(
            "dataset_bucket").parquet(self.path)

    def record(self, dataset_id: str, run_id: str, status: str, **fields) -> None:
        """Append one status event of one run."""
        if status != "running" and status not in FINAL:
            raise ValueError(f"unknown run status {status!r}")
        row = self.spark.createDataFrame(
            [(dataset_id, run_id, status)], "dataset_id string, run_id string, status string")
        now = F.current_timestamp()
        stamps = {"event_time": now, "started_at" if status == "running" else "completed_at": now}
        self.append(row.withColumns({**stamps, **{k: F.lit(v) for k, v in fields.items()}}))

    def events(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA + ", dataset_bucket int").parquet(self.path)

    def runs(self, dataset_id: str | None = None) -> DataFrame:
        """Current state of all runs, or of one dataset's, whose events alone are read."""
        events = self.events()
        if dataset_id is not None:
            events = events.filter((F.col("dataset_bucket") == bucket(F.lit(dataset_id)))
                                   & (F.col("dataset_id") == dataset_id))
        return current_runs(events)


def bucket(dataset_id: Column) -> Column:
    return F.pmod(F.xxhash64(dataset_id), F.lit(BUCKETS)).cast("int")


def current_runs(events: DataFrame, run: str = "run_id", time: str = "event_time") -> DataFrame:
    """Latest known value of every field of each run.

    A later event wins; fields it leaves NULL keep their earlier value.
    """
    # Events of one moment are told apart by their own value, so that no tie is left to chance.
    order = lambda c: F.when(F.col(c).isNotNull(), F.struct(time, "_final", F.xxhash64(c)))
    fields = [c for c in events.columns if c not in (run, time, "dataset_bucket")]
    ranked = events.withColumn("_final", F.col("status").isin(*FINAL).cast("int"))
    return ranked.groupBy(run).agg(
        F.min(time).alias("created_at"), F.max(time).alias("updated_at"),
        *[F.max_by(c, order(c)).alias(c) for c in fields])


def list_runs(runs: DataFrame, dataset_id: str | None = None, limit: int = 20) -> DataFrame:
    """Newest runs of one dataset, or of every dataset when none is named."""
    order = [F.desc("created_at"), F.desc("run_id")]
    if dataset_id is not None:
        return runs.filter(F.col("dataset_id") == dataset_id).orderBy(*order).limit(limit)
    place = F.row_number().over(W.partitionBy("dataset_id").orderBy(*order))
    return runs.withColumn("place", place).filter(F.col("place") <= limit)


def list_datasets(datasets: DataFrame, limit: int = 25) -> DataFrame:
    """Datasets or workflows, newest first."""
    return (datasets.orderBy(F.desc("created_at"), F.desc("dataset_id"))
            .limit(limit))


def latest_run(runs: DataFrame) -> DataFrame:
    """The newest run of every dataset."""
    fields = [c for c in runs.columns if c != "dataset_id"]
    newest = F.max_by(F.struct(*fields), F.struct("created_at", "run_id"))
    return runs.groupBy("dataset_id").agg(newest.alias("_run")).select("dataset_id", "_run.*")


def run_outcomes(runs: DataFrame) -> DataFrame:
    """One row per run and outcome."""
    return runs.select("dataset_id", "run_id", F.col("status").alias("run_status"), "gate_status",
                       F.inline("outcomes"))


def outcomes_array(outcomes: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Outcome rows folded into the array the ledger stores; seven entries per run."""
    fields = [c for c in outcomes.columns if c not in keys]
    return outcomes.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(*fields))).alias("outcomes"))


# --- workflow views ---------------------------------------------------------
def workflow_stage(status: Column, has_profile: Column, has_cleaned: Column, has_qc: Column) -> Column:
    status = F.lower(status)
    return (
        F.when(status.isin("running", "processing"), "running")
        .when(status.isin("failed", "error"), "failed")
        .when(has_cleaned & has_qc, "completed")
        .when(has_profile, "prechecked").otherwise("uploaded"))


def next_actions(stage: Column) -> Column:
    table = F.create_map(*[x for name, actions in rules.STAGE_ACTIONS.items()
                           for x in (F.lit(name), F.array(*[F.lit(a) for a in actions]))])
    return F.coalesce(F.try_element_at(table, stage), F.array(F.lit("refresh_workflow")))


def precheck_summary(datasets: DataFrame) -> DataFrame:
    """Pre-clean decision and readiness of each profiled dataset."""
    return datasets.select(
        "dataset_id", F.coalesce("decision", F.lit("needs_review")).alias("decision_status"),
        F.coalesce("reasons", F.array().cast("array<string>")).alias("decision_reasons"),
        F.coalesce("actions", F.array().cast("array<string>")).alias("recommended_actions"),
        "readiness_score", "readiness_band", "primary_domain",
        F.coalesce("sampled", F.lit(False)).alias("is_sampled"))


def result_summary(runs: DataFrame) -> DataFrame:
    """Release view of each finished run."""
    return runs.select(
        "dataset_id", F.coalesce("decision", F.lit("warn")).alias("decision_status"),
        F.coalesce("release_recommendation", F.lit("Look at the outcomes before sharing."))
        .alias("release_recommendation"),
        F.coalesce("gate_status", F.lit("warn")).alias("quality_gate_status"),
        F.col("readiness_score").alias("rag_score"), F.col("score_delta").alias("rag_score_delta"))


def execution_summary(datasets: DataFrame, runs: DataFrame) -> DataFrame:
    """How each dataset was last processed; the latest run wins over the dataset."""
    latest = latest_run(runs).select(
        "dataset_id", *[F.col(c).alias(f"run_{c}")
                        for c in ("run_id", "cleanup_mode", "performance_mode", "status")])
    return datasets.join(latest, "dataset_id", "left").select(
        "dataset_id", F.col("run_run_id").alias("latest_run_id"),
        F.coalesce("run_cleanup_mode", "cleanup_mode", F.lit("deterministic")).alias("cleanup_mode"),
        F.coalesce("run_performance_mode", F.lit("balanced")).alias("performance_mode"),
        F.coalesce("run_status", "status").alias("status"))
