"""Rows of two tables matched where keys repeat, against plain Python."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest

from claritable.operators import qc

SCHEMA = "key string, part int, at bigint, a string, b string"


def expected(raw, cleaned):
    """Rows of a key in their order, the k-th of one side with the k-th of the other."""
    sides = []
    for rows in (raw, cleaned):
        groups = defaultdict(list)
        for row in rows:
            groups[row[:2]].append(row)
        sides.append({k: sorted(v, key=lambda r: r[2]) for k, v in groups.items()})
    out = Counter()
    for key in {*sides[0], *sides[1]}:
        left, right = (side.get(key, []) for side in sides)
        for k in range(max(len(left), len(right))):
            x, y = (side[k] if k < len(side) else None for side in (left, right))
            note = None if x and y else "Only in the raw table." if x else "Only in the cleaned table."
            changes = [] if note else [(n, x[i], y[i]) for i, n in ((3, "a"), (4, "b")) if x[i] != y[i]]
            out[(*key, k + 1, note, tuple(changes))] += 1
    return out


def found(frame, *more):
    return Counter((r["key"], r["part"], r["occurrence"], r["note"], tuple(tuple(c) for c in r["changes"])) for r in frame.collect())


def rows_of(seed, n, hot=0):
    r = random.Random(seed)
    keys = [("k", 1), ("k", 2), ("k", None), (None, 1), (None, None), ("z", 1)]
    rows = [(*r.choice(keys), i, r.choice("xy"), r.choice(["p", None])) for i in range(n)]
    return rows + [("hot", 0, 10_000 + i, "x", "p") for i in range(hot)]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_repeated_and_null_keys(spark):
    raw, cleaned = rows_of(1, 120), rows_of(2, 100) + [("new", 1, 5, "x", None)]
    got = qc.row_changes(frame(spark, raw), frame(spark, cleaned), ["key", "part"], "at")
    assert found(got) == expected(raw, cleaned)
    assert got.count() == sum(expected(raw, cleaned).values())
    assert "Cartesian" not in got._jdf.queryExecution().toString() and "NestedLoop" not in got._jdf.queryExecution().toString()


def test_slots_of_hot_keys_lose_and_multiply_nothing(spark):
    raw = rows_of(3, 60, hot=300)
    cleaned = [(*row[:3], "changed" if row[2] % 50 == 0 else row[3], row[4]) for row in raw if row[2] != 10_007]
    got = qc.row_changes(frame(spark, raw), frame(spark, cleaned), ["key", "part"], "at", key_rows=25)
    rows = got.collect()
    assert len(rows) == len(raw)
    assert Counter((r["key"], r["part"]) for r in rows) == Counter(r[:2] for r in raw)
    assert sum(r["note"] is not None for r in rows) == 1
    hot = [r for r in rows if r["key"] == "hot"]
    assert max(Counter(r["slot"] for r in hot).values()) < 60 and len({(r["slot"], r["occurrence"]) for r in hot}) == 300


@pytest.mark.parametrize("unique", [False, True])
def test_unique_keys_and_no_order(spark, unique):
    raw = [(f"k{i}", 0, i, "x", str(i)) for i in range(40)]
    cleaned = [(*r[:3], "y", r[4]) for r in raw[5:]]
    left, right = frame(spark, raw).drop("at"), frame(spark, cleaned).drop("at")
    got = qc.row_changes(left, right, ["key", "part"], unique=unique)
    assert found(got) == expected(raw, cleaned)
    # Rows alike in key and text need no order to meet.
    same = frame(spark, raw + raw).drop("at")
    assert qc.row_changes(same, same, "key").where("change_count > 0 OR note IS NOT NULL").isEmpty()


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert qc.row_changes(none, none, "key").collect() == []
    assert [r["note"] for r in qc.row_changes(none, frame(spark, [("k", 1, 1, "a", "b")]), "key", "at").collect()] == [
        "Only in the cleaned table."]


def test_a_key_with_many_rows_is_numbered_as_a_whole(spark):
    raw = rows_of(5, 60, hot=300) + [("hot", 0, 10_400, "x", "p")] * 90
    cleaned = [(*row[:3], "changed" if row[2] % 7 == 0 else row[3], row[4]) for row in raw if row[2] != 10_007]
    got = qc.row_changes(frame(spark, raw), frame(spark, cleaned), ["key", "part"], "at", key_rows=25)
    assert found(got) == expected(raw, cleaned)
    # Null keys with many rows, and no order.
    raw = [(None, k % 2, 0, str(k), None) for k in range(120)]
    sides = [frame(spark, side).drop("at") for side in (raw, raw[2:])]
    notes = [r["note"] for r in qc.row_changes(*sides, ["key", "part"], key_rows=25).collect()]
    assert len(notes) == 120 and sum(n is not None for n in notes) == 2
