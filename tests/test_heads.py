"""Heads of columns: the first filled cells, found without sorting all of them."""

from __future__ import annotations

from collections import defaultdict

from claritable.operators import profile
from claritable.operators.cells import COLUMN, ROW, VALUE


def test_heads_are_the_first_filled_cells_and_few_are_sorted(spark):
    rows = []
    for i in range(4000):
        at = (i * 2654435761) % 4001
        rows += [("full", at, f"v{at}"), ("gaps", at, "n/a" if at % 9 else f"g{at}"), ("empty", at, "")]
        if at < 30:
            rows.append(("short", at, "x"))
    rows += [("one row", 7, f"r{i:03}") for i in range(200)]
    long = spark.createDataFrame(rows, f"{COLUMN} string, {ROW} bigint, {VALUE} string").repartition(4)
    found = profile.head_cells(long, [COLUMN], 50)
    got, want = defaultdict(list), defaultdict(list)
    for r in found.collect():
        got[r[COLUMN]].append(r[ROW])
    for name, at, value in rows:
        if value not in ("n/a", ""):
            want[name].append(at)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v)[:50] for k, v in want.items()}
    # What it read to get there is written and small: no window over all cells is left in the plan.
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
