"""Deduplication of streams: over batches, over a restart, and with late rows."""

from __future__ import annotations

import datetime as dt
from collections import Counter

import pytest

from claritable.options import CleanOptions
from claritable.plans.cleaning import fit
from claritable.streaming.clean import DedupWindow, late_rows, read_metrics, stream_clean, warnings_for

AS_OF = dt.date(2024, 1, 1)
HINTS = {"amount": ("number", None), "note": ("string", None)}
SCHEMA = "row_id bigint, at timestamp, amount string, note string"


def write(spark, folder, number, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/{number}")


def at(minute):
    return dt.datetime(2024, 1, 1, 12) + dt.timedelta(minutes=minute)


def start(spark, tmp_path, plan, **options):
    raw = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(
        str(tmp_path / "in"))
    query = stream_clean(raw, plan, str(tmp_path / "out"), str(tmp_path / "state"), keys=("row_id",), **options)
    query.awaitTermination()
    return query


def plan_for(spark, rows):
    table = spark.createDataFrame(rows, SCHEMA)
    return fit(table, CleanOptions(as_of=AS_OF), hints=HINTS, exclude=("row_id", "at"))


FIRST = [(1, at(0), "$1,000", " a  b"), (2, at(0), "1000.0", "a b"), (3, at(0), "7", None), (4, at(0), "7", "N/A")]
SECOND = [(5, at(5), "1000", "a b"), (6, at(5), "8", "c"), (7, at(5), None, None)]
THIRD = [(8, at(9), "8", "c"), (9, at(9), None, "none"), (10, at(9), "9", "c")]


@pytest.mark.parametrize("counted", [False, True])
def test_copies_over_batches_and_a_restart(spark, tmp_path, counted):
    plan, folder = plan_for(spark, FIRST + SECOND + THIRD), str(tmp_path / "in")
    options = {"dedup": DedupWindow("1 hour")} | ({"metrics": str(tmp_path / "metrics")} if counted else {})
    write(spark, folder, 1, FIRST)
    write(spark, folder, 2, SECOND)
    start(spark, tmp_path, plan, **options)
    write(spark, folder, 3, THIRD)
    start(spark, tmp_path, plan, **options)  # goes on from the checkpoint
    start(spark, tmp_path, plan, **options)  # has nothing to do
    path = f"{tmp_path}/out" + ("/batch_id=*" if counted else "")
    found = spark.read.parquet(path).collect()
    assert Counter((r["amount"], r["note"]) for r in found) == Counter(
        {(1000.0, "a b"): 1, (7.0, None): 1, (8.0, "c"): 1, (None, None): 1, (9.0, "c"): 1})
    assert {r["row_id"] for r in found} >= {6, 10} and {r["row_id"] for r in found} & {8, 9} == set()
    assert "at" not in found[0].asDict()
    if counted:
        metrics = read_metrics(spark, str(tmp_path / "metrics"))
        assert metrics.where("column_name = 'note'").groupBy().sum("rows_cleaned").first()[0] == 5


def test_late_rows_are_counted_and_state_is_bounded(spark, tmp_path):
    batches = [FIRST, [(20, at(60), "1", "x")], [(21, at(2), "2", "late"), (22, at(60), "1", "x"), (23, at(58), "1000", "a b")],
               [(24, at(300), "3", "y")], [(25, at(299), "4", "z"), (26, None, "3", "y")]]
    plan, folder = plan_for(spark, [r for b in batches for r in b]), str(tmp_path / "in")
    late, kept = 0, []
    for k, rows in enumerate(batches):
        write(spark, folder, k, rows)
        query = start(spark, tmp_path, plan, dedup=DedupWindow("10 minutes", "at"))
        late += late_rows(query)
        kept.append([p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]][-1])
    found = Counter((r["amount"], r["note"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    # Past its window a row is new again: the copy of the first batch's row an hour later stays.
    assert found[1000.0, "a b"] == 2 and found[1.0, "x"] == 1 and found[2.0, "late"] == 0 and found[4.0, "z"] == 1
    assert late == 1 and kept[-1] <= 4


def test_options(spark, tmp_path):
    plan = plan_for(spark, FIRST)
    assert len(warnings_for(plan, dedup=DedupWindow("1 day"))) == len(warnings_for(plan)) - 1
    write(spark, str(tmp_path / "in"), 1, FIRST)
    with pytest.raises(ValueError, match="column of its own"):
        start(spark, tmp_path, plan, dedup=DedupWindow("1 day", "note"))
