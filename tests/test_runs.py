"""Whole runs, autopilot, streaming, sources and the ledger."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from claritable import CleanOptions, fit
from claritable.operators import ledger, qc, retrieval, validate
from claritable.plans.autopilot import autopilot, autopilot_options
from claritable.plans.runs import clean_run, precheck
from claritable.sources import delimiters, scratch, tables
from claritable.streaming import clean as streaming

AS_OF = dt.date(2026, 1, 1)


def keyed(spark, columns, rows):
    schema = "row_id bigint, " + ", ".join(f"`{c}` string" for c in columns)
    return spark.createDataFrame([(i + 1, *r) for i, r in enumerate(rows)], schema)


def test_autopilot_adds_context_to_a_table_without_text(spark):
    df = keyed(spark, ["patient_id", "service_date", "diagnosis_code", "paid_amount"], [
        ("p1", "2025-01-01", "A10", "120"), ("p2", "2025-01-02", "B20", "140"), ("p3", "2025-01-03", "C30", "160")])
    plan, result = autopilot(df, "row_id", autopilot_options("training", as_of=AS_OF), target_score=95)
    assert result.final_score >= 95 and result.target_met
    assert "rag_context" in result.table.columns and result.table.count() == 3


def test_autopilot_projects_a_table_full_of_pii(spark):
    df = keyed(spark, ["patient_name", "email", "phone", "address", "city", "claim_id", "service_date",
                       "paid_amount", "notes"], [
        (f"{n} Doe", f"{n}@example.com", f"312-555-{i}{i}{i}{i}", f"{i} Main St", "Chicago", f"c{i}",
         f"2025-01-0{i}", str(110 + 10 * i), "") for i, n in enumerate(("john", "jane", "bob"), 1)])
    plan, result = autopilot(df, "row_id", autopilot_options("training", as_of=AS_OF), target_score=95)
    assert result.final_score >= 95 and result.table.count() == 3
    assert {"record_id", "event_date", "domain_code", "rag_context"} <= set(result.table.columns)


def test_clean_run_reports_a_negative_payment(spark):
    df = keyed(spark, ["patient_id", "dob", "paid_amount"], [("p1", "1980-01-01", "-50"), ("p2", "1990-01-01", "20")])
    options = CleanOptions(as_of=AS_OF)
    checked = precheck(df, options=options, exclude=("row_id",), order_by="row_id")
    assert checked.datasets.collect()[0]["decision"] in ("ready", "needs_review", "blocked")
    run = clean_run(df, row_key="row_id", options=options)
    assert run.table.count() == 2 and run.outcomes.count() == 7
    assert [r["issue_type"] for r in run.issues.collect()] == ["negative_amount"]
    assert run.gate.collect()[0]["gate_status"] in ("pass", "warn", "fail")


def test_streaming_equals_batch_and_counts_once(spark, tmp_path):
    rows = [("001", "12345-6789-0", "312-555-1212"), ("002", "1234-5678-90", "(773) 555-9999"),
            ("003", "0000-1111-22", "847.555.1000"), ("004", "?", "?")]
    df = spark.createDataFrame(rows, "`Patient ID` string, `NDC Code` string, Phone string")
    source = str(tmp_path / "in")
    df.repartition(2).write.option("header", True).csv(source)
    plan = fit(df, CleanOptions(as_of=AS_OF, remove_duplicates=False), streaming=True)
    raw = tables.read_delimited_stream(spark, source, df.columns, files_per_trigger=1)
    query = streaming.stream_clean(raw, plan, str(tmp_path / "out"), str(tmp_path / "cp"),
                                   metrics=str(tmp_path / "m"), issues=str(tmp_path / "i"))
    query.awaitTermination()
    streamed = spark.read.parquet(str(tmp_path / "out") + "/batch_id=*")
    assert sorted(streamed.collect()) == sorted(plan.transform(df).collect(), key=lambda r: tuple(str(x) for x in r))
    merged = {r["column_name"]: r for r in qc.merge_batches(streaming.read_metrics(spark, str(tmp_path / "m"))).collect()}
    assert merged["phone"]["rows_raw"] == 4 and merged["phone"]["missing_pct_cleaned"] == 25.0
    assert streaming.warnings_for(fit(df, CleanOptions(as_of=AS_OF), streaming=True))


def test_a_repeated_batch_is_counted_once(spark, tmp_path):
    df = spark.createDataFrame([("1",), ("?",)], "a string")
    plan = fit(df, CleanOptions(as_of=AS_OF))
    for _ in range(2):
        counted = streaming.CountedBatch(df, plan, (), 7)
        counted.rows.write.mode("overwrite").parquet(str(tmp_path / "rows"))
        counted.metrics().write.mode("overwrite").parquet(str(tmp_path / "m/batch_id=7"))
    metrics = streaming.read_metrics(spark, str(tmp_path / "m"))
    row = qc.merge_batches(metrics).collect()[0]
    assert (row["rows_raw"], row["missing_raw"]) == (2, 1)
    assert streaming.progress_percent(metrics, 8) == 25 and streaming.progress_percent(metrics, 2) == 99


def test_quoted_cells_read_alike_in_batch_and_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text('id,note\n1,"say ""hi"", ok"\n2,"two\nlines"\n3," padded "\n')
    want = [("1", 'say "hi", ok'), ("2", "two\nlines"), ("3", " padded ")]
    assert sorted(map(tuple, tables.read_table(spark, str(tmp_path / "in/a.csv")).collect())) == want
    stream = tables.read_delimited_stream(spark, str(tmp_path / "in"), ["id", "note"])
    (stream.writeStream.format("csv").options(**tables.delimited_options()).option("path", str(tmp_path / "out"))
     .option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination())
    again = tables.read_delimited(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, again.collect())) == want
    with pytest.raises(ValueError):
        tables.read_delimited(spark, str(tmp_path / "in/a.csv"), multiline=False)


def test_every_file_is_counted(spark, tmp_path):
    (tmp_path / "f").mkdir()
    for k in range(3):
        (tmp_path / f"f/{k}.csv").write_text("a\n" + ("x" * 400_000 + "\n") * (30 + k))
    got = sorted(r["row_estimate"] for r in tables.rows_per_file(spark, str(tmp_path / "f"), "csv").collect())
    assert got == [30, 31, 32] and tables.row_count(spark, str(tmp_path / "f"), "csv") == 93


def test_all_changes_and_columns_are_listed(spark):
    wide = {f"Col {k}": str(k) for k in range(60)}
    raw = spark.createDataFrame([(1, *wide.values())], ["key", *[f"col_{k}" for k in range(60)]])
    after = raw.select("key", *[F.concat(F.col(f"col_{k}"), F.lit("!")).alias(f"col_{k}") for k in range(60)])
    row = qc.row_changes(raw, after, "key").collect()[0]
    assert row["change_count"] == 60 and len(row["changes"]) == 60
    plan = fit(spark.createDataFrame([tuple(wide.values())], list(wide)), CleanOptions(as_of=AS_OF))
    columns = plan.conversion(spark)
    assert qc.column_renames(columns).count() == 60
    assert len(qc.normalization_summary(columns, "none").collect()[0]["typed_columns"]) == 60


def test_pages_and_counts(spark, tmp_path):
    path = str(tmp_path / "ten.jsonl")
    tables.write_table(spark.range(10).select("id", F.concat(F.lit("row_"), "id").alias("value")), path)
    page = tables.preview(tables.read_table(spark, path), "id", limit=3, offset=4).collect()
    assert [r["id"] for r in page] == [4, 5, 6]
    assert tables.row_count(spark, path) == 10
    parquet = str(tmp_path / "four.parquet")
    tables.write_table(spark.range(4), parquet)
    assert tables.row_count(spark, parquet) == 4
    assert tables.detect_format("x.ndjson") == "jsonl" and tables.detect_format("x.bin") == "csv"


def test_delimiters_ignore_quoted_text(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a;b\n"x, y";1\n"p, q, r";2\n')
    (tmp_path / "b.txt").write_text("a|b|c\n1|2|3\n")
    found = {r["file"].rsplit("/", 1)[1]: r["delimiter"] for r in
             delimiters.detect_delimiters(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.txt")]).collect()}
    assert found == {"a.csv": ";", "b.txt": "|"}


def test_ledger_keeps_the_latest_state(spark, tmp_path):
    book = ledger.RunLedger(spark, str(tmp_path / "runs"))
    book.record("d1", "r1", "running", performance_mode="fast")
    book.record("d1", "r1", "completed", duration_ms=5, gate_status="pass")
    book.record("d1", "r2", "running")
    runs = {r["run_id"]: r for r in book.runs().collect()}
    assert runs["r1"]["status"] == "completed" and runs["r1"]["performance_mode"] == "fast"
    assert runs["r2"]["status"] == "running" and runs["r2"]["completed_at"] is None
    assert ledger.latest_run(book.runs()).collect()[0]["run_id"] == "r2"
    assert [r["run_id"] for r in ledger.list_runs(book.runs(), "d1", 1).collect()] == ["r2"]


def test_columns_named_after_personal_data():
    names = ["row_id", "patient_name", "email", "phone", "zip", "paid_amount", "notes", "home_city"]
    assert retrieval.pii_named_columns(names) == ["patient_name", "email", "phone", "zip", "home_city"]


def test_runs_of_one_dataset_read_one_folder(spark, tmp_path):
    book = ledger.RunLedger(spark, str(tmp_path / "runs"))
    for k in range(6):
        book.record(f"d{k}", f"r{k}", "running")
    plan = book.runs("d3")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(dataset_bucket" in plan
    assert [r["run_id"] for r in book.runs("d3").collect()] == ["r3"]


def test_future_limits_do_not_follow_the_drivers_time_zone(spark, monkeypatch):
    df = spark.createDataFrame([("2024-01-01T02:00:00Z", "2024-01-02T01:00:00Z")], "dob string, visit_date string")
    for zone in ("UTC", "America/New_York", "Asia/Tokyo"):
        monkeypatch.setenv("TZ", zone)
        time.tzset()
        found = {r["issue_type"]: r["count"] for r in validate.rule_counts(df, {}, dt.date(2024, 1, 1)).collect()}
        assert found["dob_future"] == 1 and found["date_future"] == 1
    monkeypatch.undo()
    time.tzset()


def test_retrieval_text_is_kept_whole(spark):
    df = spark.createDataFrame([(1, "word " * 400), (2, None)], "row_id bigint, note string")
    rows = retrieval.chunked(retrieval.with_context(df, "row_id", ["note"])).orderBy("row_id", "chunk").collect()
    assert "".join(r["rag_context"] for r in rows if r["row_id"] == 1) == "note=" + ("word " * 400).strip()
    assert [r["rag_context"][:5] for r in rows if r["row_id"] == 2] == ["row=2"]
    plan = retrieval.with_context(df, "row_id", ["note"])._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan


def test_scratch_follows_the_cluster_setting(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    path = scratch.new_path(spark, "x")
    assert path.startswith(named) if named else "claritable" in path
    assert scratch.materialize(spark.range(3), "t").count() == 3
