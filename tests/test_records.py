"""Delimited files read in ranges, against Spark's reader of whole files."""

from __future__ import annotations

import os
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from claritable.sources import records, tables
from workload import files
from workload.registry import QUERIES


def rows_of(frame):
    return Counter(tuple(r) for r in frame.collect())


def cell(r: random.Random, sep: str) -> str:
    kind = r.random()
    if kind < 0.35:
        return "".join(r.choice("abé 1") for _ in range(r.randrange(6)))
    if kind < 0.45:
        return "".join(r.choice('a" b"') for _ in range(r.randrange(1, 5))).lstrip('"')  # quotes that open nothing
    if kind < 0.5:
        return '""'
    text = "".join(r.choice(['x', ' ', '""', sep, '\n', '\r\n', '\n\n', 'é', '""\n""']) for _ in range(r.randrange(12)))
    return f'"{text}"'


@pytest.fixture
def ranges(spark):
    """Reads files in ranges of a few bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    def size(n):
        spark.conf.set(names[0], str(n))
        spark.conf.set(names[1], "0")
    yield size
    for n, value in before.items():
        spark.conf.set(n, value)


@pytest.mark.parametrize("sep,end", [(",", "\n"), (";", "\r\n"), ("\t", "\n")])
def test_ranges_equal_whole_files(spark, tmp_path, ranges, sep, end):
    r = random.Random(ord(sep))
    (tmp_path / "in").mkdir()
    (tmp_path / "plain").mkdir()  # the same records, ended by line feeds
    for k in range(2):
        lines = [sep.join(["id", '"two\nlines"', "last"])]
        lines += [sep.join(cell(r, sep) for _ in range(3)) for _ in range(70)] + ["", "short", sep.join("abcde")]
        for folder, by in (("in", end), ("plain", "\n")):
            (tmp_path / folder / f"f{k}.csv").write_text(by.join(lines) + by * (k % 2), encoding="utf-8", newline="")
    (tmp_path / "in" / "empty.csv").write_text("")
    want = rows_of(tables.read_delimited(spark, str(tmp_path / "plain"), sep, whole_files=True))
    for size in (23, 150, 1 << 20):
        ranges(size)
        got = tables.read_delimited(spark, str(tmp_path / "in"), sep)
        assert got.columns == ["id", "two\nlines", "last"]
        found = rows_of(got)
        assert found == want, (size, list((found - want).items())[:3], list((want - found).items())[:3])


def test_one_cell_over_many_ranges(spark, tmp_path, ranges):
    path = str(tmp_path / "long.csv")
    long = "\n".join(f"line {k}, of one cell" for k in range(400))
    with open(path, "w", newline="") as file:
        file.write('a,b\n1,"' + long + '"\n2,"' + long.replace("line", '""line""') + '"\n3,end\n')
    ranges(256)
    found = tables.read_delimited(spark, path)
    assert found.rdd.getNumPartitions() > 50
    assert rows_of(found) == Counter({("1", long): 1, ("2", long.replace("line", '"line"')): 1, ("3", "end"): 1})


def test_header_over_ranges_and_files_without_rows(spark, tmp_path, ranges):
    (tmp_path / "a.csv").write_text('"a\nvery\nlong\nname",b\n1,2\n')
    (tmp_path / "b.csv").write_text('"a\nvery\nlong\nname",b\n')
    ranges(4)
    found = tables.read_delimited(spark, str(tmp_path))
    assert found.columns == ["a\nvery\nlong\nname", "b"] and rows_of(found) == Counter({("1", "2"): 1})


def test_files_without_a_line(spark, tmp_path):
    (tmp_path / "a.csv").write_text("")
    found = tables.read_delimited(spark, str(tmp_path))
    assert found.columns == [] and found.collect() == []
    assert tables.row_count(spark, str(tmp_path), "csv") == 0


def test_lines_that_end_inside_a_cell():
    begun, inside = records.open_cells(",")
    assert [bool(begun.fullmatch(x)) for x in ('"', 'a,"b', '"a""', '"a"', '"a",b', 'a"b', '"a"x,"', ',"', ' "a', '"a","b""c')] == [
        True, True, True, False, False, False, True, True, False, True]
    assert [bool(inside.fullmatch(x)) for x in ("", "a", 'a""', 'a"', 'a","', 'a",b', '"', '""', '"x,"""')] == [
        True, True, True, False, True, False, False, True, True]


def test_rows_are_counted_by_record(spark, tmp_path, ranges):
    (tmp_path / "a.csv").write_text('a,b\n"1\n\n2",3\n\n4,"""5\n"""\n')
    (tmp_path / "b.csv").write_text('a,b\n')
    ranges(5)
    found = tables.rows_per_file(spark, str(tmp_path), "csv").collect()
    assert sorted((r["file"][-5:], r["row_estimate"]) for r in found) == [("a.csv", 2), ("b.csv", 0)]
    assert tables.row_count(spark, str(tmp_path), "csv") == 2


def test_registered_ranges_grow_with_the_files_and_no_task_writes_all(spark, tmp_path):
    rows = spark.range(400).select(
        F.col("id").alias("doc_id"), F.concat(F.col("id").cast("string"), F.repeat(F.lit(" in the end, "), F.lit(6000))).alias("text"),
        F.lit("en").alias("lang"))
    rows.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    one_file_a_task = spark.newSession()
    one_file_a_task.conf.set("spark.sql.files.openCostInBytes", str(1 << 30))
    session, path = files._in_ranges(one_file_a_task, str(tmp_path))
    assert len([f for f in os.listdir(path) if f.endswith(".csv")]) == 4
    read = session.read.text(path).rdd.getNumPartitions()
    assert 100 < read <= files.MOST_RANGES + 4
    found = QUERIES["csv_ranges"](one_file_a_task, str(tmp_path))
    text = F.md5(F.concat(F.lit('"'), F.replace("text", F.lit(" the "), F.lit('\n"the",\n')), F.lit('"')))
    want = rows.select(F.col("doc_id").cast("string"), text.alias("t"))
    assert sorted((r[0], r[2]) for r in found.collect()) == sorted(tuple(r) for r in want.collect())
    assert QUERIES["row_count_ranges"](one_file_a_task, str(tmp_path)).first()[0] == 400


def test_row_estimate_writes_long_cells_in_all_tasks(spark, tmp_path, monkeypatch):
    for name in ("documents", "lineitem"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").repartition(4).write.parquet(f"{tmp_path}/{name}.parquet")
    session, write, parts = spark.newSession(), tables.write_table, []
    session.conf.set("spark.sql.files.openCostInBytes", str(1 << 30))
    monkeypatch.setattr(tables, "write_table", lambda df, path: (parts.append(df.rdd.getNumPartitions()), write(df, path)))
    rows = {r["format"]: r["rows"] for r in QUERIES["row_estimate"](session, str(tmp_path)).collect()}
    documents, items = (spark.read.parquet(f"{tmp_path}/{t}.parquet").count() for t in ("documents", "lineitem"))
    assert rows == {"csv": items, "jsonl": items, "parquet": items, "long": documents} and parts == [4, 4, 4]


def test_row_estimate_takes_less_disk_than_four_times_its_tables(spark, tmp_path, monkeypatch):
    # Texts alike in nothing: what is saved is the text's own repeats and the names of JSON keys.
    r = random.Random(3)
    texts = [(k, " ".join(f"{r.getrandbits(40):x}" for _ in range(r.choice((5, 300, 900))))) for k in range(400)]
    spark.createDataFrame(texts, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(40_000).select(
        F.xxhash64("id").alias("l_orderkey"), (F.col("id") % 50).cast("double").alias("l_quantity"), F.lit("R").alias("l_returnflag"),
    ).repartition(4).write.parquet(f"{tmp_path}/lineitem.parquet")

    def size(path):
        return sum(os.path.getsize(os.path.join(d, f)) for d, _, found in os.walk(path) for f in found)

    given, paths = size(tmp_path), iter("abc")
    monkeypatch.setattr(files, "new_path", lambda spark, label: f"{tmp_path}/scratch/{next(paths)}")
    found = {r["format"]: r["rows"] for r in QUERIES["row_estimate"](spark, str(tmp_path)).collect()}
    assert found == {"csv": 40_000, "jsonl": 40_000, "parquet": 40_000, "long": 400}
    assert 0 < size(f"{tmp_path}/scratch") < 4 * given


@pytest.mark.parametrize("name", ["csv", "tsv", "jsonl"])
def test_compressed_text_comes_back(spark, tmp_path, ranges, name):
    cells = ["plain", 'a "b"', "two\nlines", "tab\tand,comma", '"\n""\n', "é" * 3000]
    rows = spark.createDataFrame([(str(k), cells[k % 6]) for k in range(60)], "id string, text string").repartition(3)
    plain, packed = f"{tmp_path}/x.{name}", f"{tmp_path}/y.{name}.lz4/"
    tables.write_table(rows, plain)
    tables.write_table(rows, packed)
    files_of = [f for f in os.listdir(packed) if f.startswith("part-")]
    assert len(files_of) == 3 and all(f.endswith(".lz4") for f in files_of)
    ranges(2000)  # a compressed file is one range, however small these are
    assert tables.detect_format(packed) == name
    assert rows_of(tables.read_table(spark, packed)) == rows_of(tables.read_table(spark, plain)) == rows_of(rows)
    assert tables.row_count(spark, packed) == tables.row_count(spark, plain) == 60


def test_batches_of_long_lines_are_cut_and_none_is_lost(monkeypatch):
    monkeypatch.setattr(records, "_AT_ONCE", 500)
    batches = [pa.RecordBatch.from_arrays([pa.array(["x" * (5 * k) + str(k) for k in range(n)])], ["value"]) for n in (0, 1, 40)]
    parts = list(records._parts(iter(batches)))
    assert len(parts) > 10 and max(p.num_rows for p in parts) < 10
    assert [x for p in parts for x in p["value"].to_pylist()] == [x for b in batches for x in b["value"].to_pylist()]
