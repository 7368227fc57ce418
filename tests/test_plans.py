"""Shape of the physical plans that carry the load."""

import pytest
from pyspark.sql import functions as F

from claritable.functions import coerce, pii
from claritable.operators.cells import cells as cells_long
from claritable.operators.profile import histogram, measure, profile_columns
from workload import inputs
from workload.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"

def cells_of(rows):
    return cells_long(rows, {"v": "v"}, order_by="row_id")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_profile_readers_share_one_histogram(spark):
    df = profile_columns(inputs.messy(spark, SF), order_by="row_id", as_of=inputs.AS_OF, exclude=("row_id",))
    df.collect()
    plan = plan_of(df).split("== Initial Plan ==")[0]
    # One histogram for three readers, their winners once more for the lookup of long texts, which is the second scan.
    assert plan.count("ReusedExchange") == 4
    assert plan.count("FileScan parquet") == 2
    assert "WindowGroupLimit" in plan


def test_cells_are_not_read_again_where_none_is_long(spark):
    df = profile_columns(spark.createDataFrame([(i, str(i % 7)) for i in range(50)], "row_id int, v string"),
                         order_by="row_id", as_of=inputs.AS_OF, exclude=("row_id",))
    assert df.collect()[0]["distinct_count"] == 7
    assert "collect_set" not in plan_of(df).split("== Initial Plan ==")[0]


def test_long_values_are_counted_by_digest(spark):
    """Texts longer than a key: repeated, alike in their firsts, with signals, a date, a number, and none at all."""
    cells = ["x" * 40 + str(i % 3) for i in range(30)] + [
        "write to jo@example.org or call 312-555-1212 today", " " * 30 + "2023-02-03", "0" * 40 + "7",
        " " * 40 + "60601", " " * 40 + "Monday, February 3, 2023", " " * 60, None]
    rows = spark.createDataFrame(list(enumerate(cells)), "row_id int, v string")
    got = profile_columns(rows, order_by="row_id", as_of=inputs.AS_OF, exclude=("row_id",)).first()
    assert (got["row_count"], got["non_null"], got["distinct_count"]) == (37, 35, 8)
    assert got["top_values"] == {"x" * 40 + str(i): 10 for i in range(3)}
    assert got["example_values"][:3] == ["x" * 40 + str(i) for i in range(3)]
    assert (got["pii_email"], got["pii_phone"]) == (1, 1)
    signals = measure(histogram(cells_of(rows), ["column_name"], inputs.AS_OF), ["column_name"], inputs.AS_OF).first()
    assert (signals["date_count"], signals["number_count"], signals["zip_count"]) == (2, 2, 1)
    assert (signals["num_min"], signals["num_max"]) == (7.0, 60601.0)


def test_cheap_tests_pass_all_that_parses(spark):
    value = F.col("v")
    forms = ["2023-02-03", " 2/3/2023", "3-Feb-23", "Feb 3, 2023 5:00 pm", "MAY 1 2020", "tues, 5/6/2020", "20230203",
             "20230203 101112", "2023-02", "sat May 2 2020", "1e5", " -.5", "+3.", "$1,200", "12345-6789", "\u00a060601"]
    rows = spark.createDataFrame([(f,) for f in forms], "v string").select(
        coerce.may_be_date(value).alias("d"), coerce.timestamp(value, inputs.AS_OF).alias("ts"),
        coerce.may_be_number(value).alias("m"), coerce.plain_number(value).alias("n"),
        coerce.looks_numeric(value).alias("l"), pii.is_zip(value).alias("z"))
    found = rows.collect()
    assert sum(r.ts is not None for r in found) >= 9
    for r in found:
        assert r.d or r.ts is None
        assert r.m or (r.n is None and not r.l and not r.z)


@pytest.mark.parametrize("name", [
    "clean_table", "profile_table", "dedup_keep_first", "issue_severity", "row_changes", "release_decision",
    "runs_latest", "standardize_catalog", "rag_projection_orders"])
def test_no_python_and_no_pair_joins(spark, name):
    plan = plan_of(QUERIES[name](spark, SF))
    for node in ("Python", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in plan


def test_scans_read_only_the_columns_they_need(spark):
    plan = plan_of(QUERIES["pii_counts"](spark, SF))
    assert "ReadSchema: struct<text:string,lang:string>" in plan


def test_a_hot_row_is_merged_before_the_shuffle(spark):
    plan = plan_of(QUERIES["dedup_keep_first"](spark, SF))
    assert "partial_min(row_id" in plan


def test_every_check_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) >= 151


def test_profile_does_not_depend_on_partitioning(spark):
    df = inputs.messy(spark, SF)
    one = profile_columns(df.coalesce(1), order_by="row_id", as_of=inputs.AS_OF, exclude=("row_id",))
    many = profile_columns(df.repartition(9), order_by="row_id", as_of=inputs.AS_OF, exclude=("row_id",))
    pick = lambda p: sorted(p.drop("top_values", "num_mean").collect(), key=lambda r: r["position"])
    assert pick(one) == pick(many)


def test_entry_runs(spark):
    import __spark_entry__ as driver
    assert driver.entry(spark).count() == 4
    assert driver.queries().keys() >= driver.oracle_sql().keys()


def test_sketches_stay_near_the_exact_counts(spark):
    from claritable.operators import profile
    df = spark.read.parquet("/root/testdata/sf0.01/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus")
    near = {r["column_name"]: r for r in profile.approximate_profile(df).collect()}
    for name in df.columns:
        exact = df.select(name).distinct().count()
        # Three standard errors of the sketch, which has one of 5 %.
        assert abs(near[name]["distinct_count"] - exact) <= 0.15 * exact
        assert near[name]["row_count"] == 15000 and near[name]["missing_pct"] == 0
