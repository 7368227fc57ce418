"""Formats, delimiters, paging, row counts and the streaming clean."""

from __future__ import annotations

from pyspark.sql import functions as F

from claritable.operators import qc
from claritable.operators.cells import COLUMN
from claritable.sources import delimiters, tables
from claritable.sources.scratch import new_path
from claritable.streaming import clean as streaming
from workload import sql
from workload.cleaning import CLEAN_CLAIMS_SQL, CLEAN_MESSY_SQL, claims_plan, gate_sql, messy_plan
from workload.inputs import CLAIMS, CLAIMS_COLUMNS, MESSY, MESSY_COLUMNS, messy, table
from workload.registry import query
from workload.scores import MESSY_RULES, failing

_PART_TEXT = ("SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, p_brand, p_type, CAST(p_size AS VARCHAR) AS p_size, "
              "CAST(p_retailprice AS VARCHAR) AS p_retailprice FROM part")


def _part(spark, sf):
    part = table(spark, sf, "part")
    return part.select(*[F.col(c).cast("string") for c in part.columns])


for _fmt in ("csv", "tsv", "jsonl", "parquet"):
    def _roundtrip(spark, sf, fmt=_fmt):
        path = f"{new_path(spark, 'roundtrip')}.{fmt}"
        tables.write_table(_part(spark, sf), path)
        return tables.read_table(spark, path)
    query(f"{_fmt}_roundtrip", _PART_TEXT)(_roundtrip)


@query("csv_quoting", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, lang FROM documents")
def _(spark, sf):
    path = f"{new_path(spark, 'quoted')}.csv"
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string"), "text", "lang")
    tables.write_table(docs, path)
    return tables.read_table(spark, path)


#: Ranges are of 64 kB, or of a size that gives no more than this many over all files.
MOST_RANGES = 256


def _in_ranges(spark, sf):
    """The documents, quotes and line breaks in their cells, as a file of each task, and a session that reads these in ranges."""
    path = f"{new_path(spark, 'ranges')}.csv"
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").cast("string"), F.concat(F.lit('"'), F.replace("text", F.lit(" the "), F.lit('\n"the",\n')), F.lit('"'))
        .alias("text"), "lang")
    tables.write_table(docs, path)
    size = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0] or 0
    session = spark.newSession()
    session.conf.set("spark.sql.files.maxPartitionBytes", str(max(64 << 10, -(-size // MOST_RANGES))))
    session.conf.set("spark.sql.files.openCostInBytes", "0")
    return session, path


@query("csv_ranges", """SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang,
 md5('"' || replace(text, ' the ', chr(10) || '"the",' || chr(10)) || '"') AS text_md5 FROM documents""")
def _(spark, sf):
    session, path = _in_ranges(spark, sf)
    return tables.read_table(session, path).select("doc_id", "lang", F.md5("text").alias("text_md5"))


@query("row_count_ranges", "SELECT count(*) AS rows FROM documents")
def _(spark, sf):
    session, path = _in_ranges(spark, sf)
    return tables.rows_per_file(session, path).agg(F.sum("row_estimate").alias("rows"))


@query("jsonl_nested", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def _(spark, sf):
    path = f"{new_path(spark, 'nested')}.jsonl"
    events = table(spark, sf, "events")
    tables.write_table(events.select("event_id", F.from_json("props", "k bigint").alias("props")), path)
    nested = tables.read_table(spark, path)
    return nested.select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


_SEPARATORS = (("comma", ","), ("tab", "\t"), ("semicolon", ";"), ("pipe", "|"))


def _mixed_files(spark, sf):
    root = new_path(spark, "mixed")
    part = _part(spark, sf)
    for name, sep in _SEPARATORS:
        part.withColumn("origin", F.lit(name)).write.option("header", True).option("sep", sep).csv(f"{root}/{name}")
    return root


@query("delimiters", " UNION ALL ".join(
    f"SELECT '{n}' AS origin, {sql.quote(s)} AS delimiter, count(*) > 0 AS steady FROM part" for n, s in _SEPARATORS))
def _(spark, sf):
    found = delimiters.detect_delimiters(spark, f"{_mixed_files(spark, sf)}/*")
    return found.select(F.regexp_extract("file", r"/(\w+)/[^/]*$", 1).alias("origin"), "delimiter", "steady").distinct()


@query("read_mixed", " UNION ALL ".join(f"SELECT *, '{n}' AS origin FROM ({_PART_TEXT})" for n, _ in _SEPARATORS))
def _(spark, sf):
    return delimiters.read_mixed(spark, f"{_mixed_files(spark, sf)}/*")


@query("preview_page", "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100")
def _(spark, sf):
    return tables.preview(table(spark, sf, "orders"), "o_orderkey", 50, 100).select("o_orderkey", "o_orderstatus")


@query("preview_counted", "SELECT o_orderkey, o_orderstatus, (SELECT count(*) FROM orders) AS row_count FROM orders "
       "ORDER BY o_orderkey LIMIT 50")
def _(spark, sf):
    return tables.counted_preview(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", 50)


@query("preview_deep", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey > 10000 ORDER BY o_orderkey LIMIT 20")
def _(spark, sf):
    return tables.page_after(table(spark, sf, "orders"), "o_orderkey", 10000, 20).select("o_orderkey", "o_orderstatus")


_ESTIMATED = {
    "csv": "lineitem", "jsonl": "lineitem",
    # Long cells and few rows: each line is one document, its line breaks written as spaces; a file of each task.
    "long": "documents",
}


@query("row_estimate", " UNION ALL ".join(
    f"SELECT '{k}' AS format, count(*) AS rows FROM {t}" for k, t in {**_ESTIMATED, "parquet": "lineitem"}.items()))
def _(spark, sf):
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_quantity", "l_returnflag")
    docs = table(spark, sf, "documents").select("doc_id", F.repeat(F.regexp_replace("text", r"\s+", " "), F.lit(6)).alias("text"))
    out = table(spark, sf, "lineitem").agg(F.lit("parquet").alias("format"), F.count(F.lit(1)).alias("rows"))
    # Keys of JSON and repeated texts are many times the tables, so those files are compressed.
    for name, rows, fmt in (("csv", items, "csv"), ("jsonl", items, "jsonl.lz4"), ("long", docs, "csv.lz4")):
        path = f"{new_path(spark, 'estimate')}.{fmt}"
        tables.write_table(rows, path)
        counted = tables.rows_per_file(spark, path)
        out = out.unionByName(counted.agg(F.lit(name).alias("format"), F.sum("row_estimate").alias("rows")))
    return out


# --- streaming --------------------------------------------------------------
def _customer_stream(spark, sf):
    schema = table(spark, sf, "customer").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "customer.parquet").parquet(sf)
    return spark.sql(MESSY.replace("FROM customer", "FROM {customer}"), customer=source)


def _run_stream(spark, sf, source=None, **sinks):
    root = new_path(spark, "stream")
    plan = messy_plan(spark, sf, remove_duplicates=False)
    paths = {name: f"{root}/{name}" for name in sinks}
    started = streaming.stream_clean(source or _customer_stream(spark, sf), plan, f"{root}/rows", f"{root}/checkpoint",
                                     keys=("row_id",), **paths)
    started.awaitTermination()
    return root


@query("stream_clean", f"{sql.WITH_MESSY} {CLEAN_MESSY_SQL}")
def _(spark, sf):
    from claritable.functions import coerce
    root = _run_stream(spark, sf)
    return spark.read.parquet(f"{root}/rows").withColumn("visit_date", coerce.date_to_text(F.col("visit_date")))


def _claims_stream(spark, sf):
    schema = table(spark, sf, "lineitem").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "lineitem.parquet").parquet(sf)
    return spark.sql(CLAIMS.replace("FROM lineitem", "FROM {lineitem}"), lineitem=source)


@query("stream_dedup", f"{sql.WITH_CLAIMS} {CLEAN_CLAIMS_SQL}")
def _(spark, sf):
    """A third of the claims are copies of one."""
    root, plan = new_path(spark, "stream"), claims_plan(spark, sf)
    streaming.stream_clean(_claims_stream(spark, sf), plan, f"{root}/rows", f"{root}/checkpoint",
                           dedup=streaming.DedupWindow("1 day")).awaitTermination()
    return spark.read.parquet(f"{root}/rows")


@query("stream_dedup_metrics", f"""{sql.WITH_CLAIMS}, c AS ({CLEAN_CLAIMS_SQL}) """ + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) AS rows_cleaned, count(*) - count({c}) AS missing_cleaned FROM c"
    for c in CLAIMS_COLUMNS))
def _(spark, sf):
    root, plan = new_path(spark, "stream"), claims_plan(spark, sf)
    streaming.stream_clean(_claims_stream(spark, sf), plan, f"{root}/rows", f"{root}/checkpoint", metrics=f"{root}/metrics",
                           dedup=streaming.DedupWindow("1 day")).awaitTermination()
    return qc.merge_batches(streaming.read_metrics(spark, f"{root}/metrics")).select(
        COLUMN, "rows_cleaned", "missing_cleaned")


_RAW_MISSING = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) AS rows_raw, count(*) - count({sql.norm(c)}) AS missing_raw FROM messy"
    for c in MESSY_COLUMNS)
_CLEAN_MISSING = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) - " + ("0" if c == "empty_col" else f"count({c})")
    + " AS missing_cleaned FROM cleaned" for c in MESSY_COLUMNS)


def _metrics_of(spark, root):
    return qc.merge_batches(streaming.read_metrics(spark, f"{root}/metrics")).select(
        COLUMN, "rows_raw", "missing_raw", "missing_cleaned", "invalid", "missing_pct_raw", "missing_pct_cleaned")


_METRICS = f"""{sql.WITH_MESSY}, cleaned AS ({CLEAN_MESSY_SQL}), r AS ({_RAW_MISSING}), c AS ({_CLEAN_MISSING}),
g AS ({gate_sql('safe')})
SELECT column_name, CAST(rows_raw AS BIGINT) AS rows_raw, missing_raw, missing_cleaned, invalid,
 {sql.pct('missing_raw', 'rows_raw')} AS missing_pct_raw, {sql.pct('missing_cleaned', 'rows_raw')} AS missing_pct_cleaned
FROM r JOIN c USING (column_name) JOIN g USING (column_name)"""


@query("stream_metrics", _METRICS)
def _(spark, sf):
    return _metrics_of(spark, _run_stream(spark, sf, metrics=True))


# --- delimited streams ---
def _customer_files(spark, sf):
    """The messy table as a folder of comma-separated files."""
    path = f"{new_path(spark, 'messy')}.csv"
    tables.write_table(messy(spark, sf).withColumn("row_id", F.col("row_id").cast("string")), path)
    return tables.read_delimited_stream(spark, path, ["row_id", *MESSY_COLUMNS], files_per_trigger=2).withColumn(
        "row_id", F.col("row_id").cast("bigint"))


@query("stream_clean_csv", f"{sql.WITH_MESSY} {CLEAN_MESSY_SQL}")
def _(spark, sf):
    from claritable.functions import coerce
    root = _run_stream(spark, sf, source=_customer_files(spark, sf))
    return spark.read.parquet(f"{root}/rows").withColumn("visit_date", coerce.date_to_text(F.col("visit_date")))


@query("stream_metrics_csv", _METRICS)
def _(spark, sf):
    return _metrics_of(spark, _run_stream(spark, sf, source=_customer_files(spark, sf), metrics=True))


@query("stream_documents_csv", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, md5('\"' || text || '\"') AS text_md5, lang FROM documents")
def _(spark, sf):
    """Quotes, commas and line breaks through a delimited source and sink of a stream."""
    root = new_path(spark, "quoted")
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").cast("string"), F.concat(F.lit('"'), "text", F.lit('"')).alias("text"), "lang")
    tables.write_table(docs, f"{root}/in.csv")
    rows = tables.read_delimited_stream(spark, f"{root}/in.csv", ["doc_id", "text", "lang"])
    (rows.writeStream.format("csv").options(**tables.delimited_options()).option("path", f"{root}/out.csv")
     .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination())
    return tables.read_table(spark, f"{root}/out.csv").select("doc_id", F.md5("text").alias("text_md5"), "lang")


@query("stream_issues", f"""{sql.WITH_MESSY}, cleaned AS ({CLEAN_MESSY_SQL}) """ + " UNION ALL ".join(
    f"SELECT '{i}' AS issue_type, '{c}' AS column_name, count(*) FILTER ({failing(i, c)}) AS count FROM cleaned"
    for i, c in MESSY_RULES))
def _(spark, sf):
    root = _run_stream(spark, sf, issues=True)
    return spark.read.parquet(f"{root}/issues/batch_id=*").groupBy("issue_type", COLUMN).agg(
        F.sum("count").alias("count"))


@query("stream_preview", f"{sql.WITH_MESSY} SELECT row_id, phone, gender FROM ({CLEAN_MESSY_SQL}) ORDER BY row_id LIMIT 50")
def _(spark, sf):
    root = _run_stream(spark, sf)
    return tables.preview(spark.read.parquet(f"{root}/rows"), "row_id", 50).select("row_id", "phone", "gender")
