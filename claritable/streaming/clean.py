"""Streaming clean: a fitted plan over a file stream, with exactly-once counters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from claritable import rules
from claritable.operators import validate
from claritable.operators.cells import COLUMN
from claritable.plans.cleaning import STRING, CleaningPlan
from claritable.sources.tables import delimited_options, write_table

_FORMATS = {"csv": "csv", "jsonl": "json", "parquet": "parquet"}


#: Column names of the streaming deduplication.
_SEEN, _DIGEST = "_seen", "_digest"


@dataclass(frozen=True)
class DedupWindow:
    """Repeated rows of a stream are dropped for ``within`` from the first of them.

    Rows compare on their cleaned columns without the keys. The state of the stream holds a digest of 128 bits for
    each distinct row, for as long as a copy would still be dropped, so it is bounded by the rows of one window.
    Time is the time of arrival; it is stored with the offsets of each batch, so a batch repeated after a failure
    decides as it did before, and no row comes late. With ``time``, a timestamp column of the source, it is the
    event time: rows more than ``within`` behind the newest are late, are not written, and are counted by
    :func:`late_rows`.
    """

    within: str
    time: str | None = None

    def apply(self, rows: DataFrame, compared: list[str]) -> DataFrame:
        """``rows`` without copies; ``time`` is dropped."""
        cells = F.to_json(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(compared)]))
        digest = F.substring(F.unhex(F.sha2(cells, 256)), 1, 16)
        seen = F.col(f"`{self.time}`").cast("timestamp") if self.time else F.current_timestamp()
        # A row without a time is taken for one of now.
        stamped = rows.withColumns({_SEEN: F.coalesce(seen, F.current_timestamp()), _DIGEST: digest})
        gone = [_SEEN, _DIGEST, *([self.time] if self.time else [])]
        return stamped.withWatermark(_SEEN, self.within).dropDuplicatesWithinWatermark([_DIGEST]).drop(*gone)


def late_rows(query) -> int:
    """Rows that a query has left out as late, as far back as it keeps its progress."""
    return sum(operator["numRowsDroppedByWatermark"] for progress in query.recentProgress
               for operator in progress["stateOperators"])


def warnings_for(plan: CleaningPlan, streaming: bool = True, dedup: DedupWindow | None = None) -> list[str]:
    options = plan.options
    found = []
    if options.performance == "ultra_fast":
        found.append(rules.WARN_ULTRA)
    elif options.performance == "fast":
        found.append(rules.WARN_FAST)
    if streaming and options.remove_duplicates and dedup is None:
        found.append(rules.WARN_STREAM_DEDUP)
    if not options.normalize_missing:
        found.append(rules.WARN_ULTRA_MISSING)
    if not options.validates:
        found.append(rules.WARN_NO_VALIDATION)
    return found


class CountedBatch:
    """A micro-batch cleaned for its output, counted by Spark as it is written.

    The counters are sums over the projected rows that ``observe`` takes on their way to
    the output: the batch is read once and cleaned once.  They are there after the write.
    """

    def __init__(self, batch: DataFrame, plan: CleaningPlan, keys: tuple[str, ...], batch_id: int,
                 flagged: bool = False):
        """``flagged`` says that the batch is projected already, as a deduplicated stream is."""
        self.plan, self.batch_id, self.seen = plan, batch_id, Observation()
        rows = batch if flagged else plan.project_flagged(batch, keys)
        self.checks = [
            (name, *rule) for name in (c.name for c in plan.kept()) for rule in
            validate.rules_for(rows, name, plan.hints.get(name), plan.options.as_of)
        ] if plan.options.validates else []
        count = lambda flag, name: F.count_if(flag).alias(name)
        sums = [F.count(F.lit(1)).alias("rows")]
        for c in plan.columns:
            sums.append(count(F.col(f"`missing:{c.name}`"), f"missing:{c.name}"))
            if not c.dropped:
                sums.append(count(F.col(f"`{c.name}`").isNull(), f"left:{c.name}"))
            if c.primitive != STRING:
                sums.append(count(F.col(f"`invalid:{c.name}`"), f"invalid:{c.name}"))
        sums += [count(failing, f"rule:{i}") for i, (_, _, _, failing) in enumerate(self.checks)]
        kept = [*keys, *(c.name for c in plan.kept())]
        self.rows = plan.privatize(
            rows.observe(self.seen, *sums).select(*[F.col(f"`{c}`") for c in kept]), keys)
        self.spark = batch.sparkSession

    def metrics(self) -> DataFrame:
        """Rows, missing and invalid cells of the written batch, one row per column."""
        found = self.seen.get
        total = found["rows"]
        return self.spark.createDataFrame(
            [(self.plan.dataset, self.batch_id, c.name, total, total, found[f"missing:{c.name}"],
              found.get(f"left:{c.name}", total), found.get(f"invalid:{c.name}", 0)) for c in self.plan.columns],
            "dataset_id string, batch_id bigint, column_name string, rows_raw bigint, rows_cleaned bigint, "
            "missing_raw bigint, missing_cleaned bigint, invalid bigint")

    def issues(self) -> DataFrame:
        """Failing rows of every rule and column of the written batch."""
        found, order = self.seen.get, list(rules.ISSUE_WEIGHTS)
        return self.spark.createDataFrame(
            [(self.plan.dataset, found["rows"], order.index(issue), issue, name, message, found[f"rule:{i}"])
             for i, (name, issue, message, _) in enumerate(self.checks)],
            "dataset_id string, row_count bigint, rule_order int, issue_type string, column_name string, "
            "message string, count bigint")


def stream_clean(raw: DataFrame, plan: CleaningPlan, output: str, checkpoint: str, *,
                 fmt: str = "parquet", keys: tuple[str, ...] = (), metrics: str | None = None,
                 issues: str | None = None, once: bool = True, dedup: DedupWindow | None = None):
    """Start the streaming clean and return its query.

    ``dedup`` drops repeated rows; counters are then those of the rows that stay.

    Without ``metrics`` rows go straight to the file sink.  With it every micro-batch is
    written together with its counters into folders named by batch id: a batch repeated
    after a failure overwrites its own folder and is counted once.
    """
    if fmt not in _FORMATS:
        raise ValueError("streaming output supports csv, jsonl or parquet")
    timed = (dedup.time,) if dedup is not None and dedup.time else ()
    if set(timed) & {*keys, *(c.name for c in plan.columns)}:
        raise ValueError("the time of deduplication must be a column of its own, neither a key nor a cleaned one")
    compared = [c.name for c in plan.kept()]
    if metrics is None and issues is None:
        rows = plan.project(raw, (*keys, *timed))
        if dedup is not None:
            rows = dedup.apply(rows, compared)
        writer = plan.privatize(rows, keys).writeStream.format(_FORMATS[fmt]).option("path", output)
        if fmt == "csv":
            writer = writer.options(**delimited_options())
        if fmt == "jsonl":
            writer = writer.option("ignoreNullFields", False)
    else:
        def write_batch(batch: DataFrame, batch_id: int) -> None:
            folder = f"batch_id={batch_id}"
            counted = CountedBatch(batch, plan, keys, batch_id, flagged=dedup is not None)
            write_table(counted.rows, f"{output}/{folder}", fmt, mode="overwrite")
            if metrics is not None:
                counted.metrics().write.mode("overwrite").parquet(f"{metrics}/{folder}")
            if issues is not None and plan.options.validates:
                counted.issues().write.mode("overwrite").parquet(f"{issues}/{folder}")

        if dedup is not None:
            raw = dedup.apply(plan.project_flagged(raw, (*keys, *timed)), compared)
        writer = raw.writeStream.foreachBatch(write_batch)
    writer = writer.option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Counters of all batches."""
    return spark.read.parquet(f"{path}/batch_id=*")


def progress_percent(metrics: DataFrame, total_rows: int) -> int:
    """Share of the expected rows that the written batches hold, at most 99 until the stream ends.

    Read from the counters, which know every batch; a query's own progress keeps the last ones only.
    """
    first = metrics.agg(F.min(COLUMN)).first()[0]
    read = metrics.filter(F.col(COLUMN) == first).agg(F.sum("rows_raw")).first()[0] or 0
    return min(99, int(read / max(1, total_rows) * 100))
