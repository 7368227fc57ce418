"""Views over the given tables that the registered queries start from.

``MESSY`` and ``CLAIMS`` are portable SQL: Spark and the oracle read the same text.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

AS_OF = dt.date(2024, 1, 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# One messy patient row per customer.
MESSY = """
SELECT c_custkey AS row_id,
  lpad(CAST(c_custkey AS STRING), 6, '0') AS patient_id,
  CASE c_custkey % 6
    WHEN 0 THEN CAST(1925 + c_custkey % 90 AS STRING) || '-' || lpad(CAST(1 + c_custkey % 12 AS STRING), 2, '0') || '-' || lpad(CAST(1 + c_custkey % 28 AS STRING), 2, '0')
    WHEN 1 THEN CAST(1 + c_custkey % 12 AS STRING) || '/' || CAST(1 + c_custkey % 28 AS STRING) || '/' || CAST(1925 + c_custkey % 90 AS STRING)
    WHEN 2 THEN lpad(CAST(1 + c_custkey % 28 AS STRING), 2, '0') || '-Feb-' || CAST(1925 + c_custkey % 90 AS STRING)
    WHEN 3 THEN CAST(1925 + c_custkey % 110 AS STRING) || '/' || lpad(CAST(1 + c_custkey % 12 AS STRING), 2, '0') || '/01'
    WHEN 4 THEN 'bad-date' ELSE 'N/A' END AS dob,
  CASE c_custkey % 4
    WHEN 0 THEN '2023-0' || CAST(1 + c_custkey % 9 AS STRING) || '-15T12:00:00Z'
    WHEN 1 THEN '2023-0' || CAST(1 + c_custkey % 9 AS STRING) || '-15 08:30:00'
    WHEN 2 THEN '2031-01-0' || CAST(1 + c_custkey % 9 AS STRING) ELSE '2023-12-01' END AS visit_date,
  CASE c_custkey % 8
    WHEN 0 THEN '$1,' || lpad(CAST(c_custkey % 1000 AS STRING), 3, '0') || '.50'
    WHEN 1 THEN '(' || CAST(c_custkey % 500 AS STRING) || '.25)'
    WHEN 2 THEN ' ' || CAST(c_custkey % 900 AS STRING) || ' '
    WHEN 3 THEN CAST(c_custkey % 100 AS STRING) || '%'
    WHEN 4 THEN '-' WHEN 5 THEN '12 USD' ELSE CAST(c_custkey % 700 AS STRING) || '.00' END AS paid_amount,
  CASE c_custkey % 5 WHEN 0 THEN 'a10' WHEN 1 THEN 'E11.9' WHEN 2 THEN 'j45 .909' WHEN 3 THEN '123.45' ELSE 'null' END AS icd_code,
  CASE c_custkey % 5 WHEN 0 THEN '99213' WHEN 1 THEN 'ABCDE' ELSE '80053' END AS cpt,
  CASE c_custkey % 4 WHEN 0 THEN 'J1234' WHEN 1 THEN '1234' ELSE 'A0428' END AS hcpcs,
  CASE c_custkey % 4 WHEN 0 THEN '4548-4' WHEN 1 THEN '12-XYZ' ELSE '718-7' END AS loinc,
  CASE c_custkey % 4 WHEN 0 THEN '0002-8215-01' WHEN 1 THEN '54868-5882-0' WHEN 2 THEN '123' ELSE 'NDC' END AS ndc,
  CASE c_custkey % 3 WHEN 0 THEN '860975' WHEN 1 THEN 'RX' ELSE '12A45' END AS rxnorm,
  CASE c_custkey % 7 WHEN 0 THEN '12345' ELSE '1' || lpad(CAST(c_custkey % 1000000 AS STRING), 9, '0') END AS npi,
  CASE c_custkey % 5
    WHEN 0 THEN '312-555-' || lpad(CAST(c_custkey % 10000 AS STRING), 4, '0')
    WHEN 1 THEN '+1 (773) 555.' || lpad(CAST(c_custkey % 10000 AS STRING), 4, '0')
    WHEN 2 THEN '847555' || lpad(CAST(c_custkey % 10000 AS STRING), 4, '0')
    WHEN 3 THEN '555-010' ELSE '?' END AS phone,
  CASE c_custkey % 4 WHEN 0 THEN 'bad-email@' WHEN 1 THEN 'Unknown' ELSE 'user' || CAST(c_custkey AS STRING) || '@example.org' END AS email,
  CASE c_custkey % 4 WHEN 0 THEN lpad(CAST(c_custkey % 100000 AS STRING), 5, '0') WHEN 1 THEN '60601-1234' WHEN 2 THEN '12' ELSE '' END AS zip,
  CASE c_custkey % 6 WHEN 0 THEN ' Male' WHEN 1 THEN 'woman' WHEN 2 THEN 'f' WHEN 3 THEN 'unknown' WHEN 4 THEN 'u' ELSE 'X' END AS gender,
  CASE c_custkey % 5 WHEN 0 THEN 'Yes' WHEN 1 THEN 'n' WHEN 2 THEN 'TRUE' WHEN 3 THEN '0' ELSE 'maybe' END AS consent_flag,
  c_name AS patient_name,
  CASE c_custkey % 5
    WHEN 0 THEN '  Needs' || chr(9) || 'follow   up  '
    WHEN 1 THEN 'mail user' || CAST(c_custkey AS STRING) || '@example.org or call 312-555-1212'
    WHEN 2 THEN 'ssn 123-45-6789, o''neil-smith seen for persistent cough and fatigue'
    WHEN 3 THEN 'NONE' ELSE c_mktsegment END AS notes,
  '' AS empty_col
FROM customer
"""

MESSY_COLUMNS = (
    "patient_id", "dob", "visit_date", "paid_amount", "icd_code", "cpt", "hcpcs", "loinc", "ndc",
    "rxnorm", "npi", "phone", "email", "zip", "gender", "consent_flag", "patient_name", "notes",
    "empty_col")

# One messy claim row per line item; a third of the rows are copies of one claim.
CLAIMS = """
SELECT row_id,
  'CLM-' || lpad(CAST(ok % 4000 AS STRING), 7, '0') AS claim_id,
  'PLAN-' || CAST(sk % 20 AS STRING) AS plan,
  CASE ln % 5
    WHEN 0 THEN CAST(day AS STRING)
    WHEN 1 THEN CAST(month(day) AS STRING) || '/' || CAST(day(day) AS STRING) || '/' || CAST(year(day) AS STRING)
    WHEN 2 THEN CAST(day AS STRING) || 'T23:30:00-0500'
    WHEN 3 THEN replace(CAST(day AS STRING), '-', '/')
    ELSE CASE WHEN pk % 4 = 0 THEN 'pending' ELSE 'n/a' END END AS service_date,
  CASE ok % 6
    WHEN 0 THEN '$' || CAST(qty AS STRING) || ',500.75'
    WHEN 1 THEN '(' || CAST(qty AS STRING) || '.50)'
    WHEN 2 THEN ' ' || CAST(qty AS STRING) || '.25 '
    WHEN 3 THEN 'unk' WHEN 4 THEN CAST(qty AS STRING) || ' USD'
    ELSE CAST(qty AS STRING) END AS paid_amount,
  CASE pk % 6 WHEN 0 THEN 'e11.9' WHEN 1 THEN 'I10' WHEN 2 THEN 'j45 .909' WHEN 3 THEN '123.45'
    WHEN 4 THEN 'None' ELSE 'M54.5' END AS icd_code,
  CASE sk % 4 WHEN 0 THEN '0002-8215-01' WHEN 1 THEN '54868588201' WHEN 2 THEN '123' ELSE '?' END AS ndc,
  CASE flag WHEN 'A' THEN 'Y' WHEN 'R' THEN 'no' ELSE 'TRUE' END AS accepted_flag,
  CASE sk % 5 WHEN 0 THEN 'm' WHEN 1 THEN 'Female' WHEN 2 THEN ' other ' WHEN 3 THEN 'unk' ELSE 'nonbinary' END AS gender,
  CASE ln % 5
    WHEN 0 THEN 'Claim  reviewed by analyst; contact clerk' || CAST(sk % 50 AS STRING) || '@example.org about the missing   attachment'
    WHEN 1 THEN 'Call 312-555-0' || lpad(CAST(sk % 1000 AS STRING), 3, '0') || ' before noon'
    WHEN 2 THEN '' ELSE 'Paid in full after the second review of the documents' END AS notes
FROM (
  SELECT l_orderkey * 10 + l_linenumber AS row_id,
    CASE WHEN l_partkey % 3 = 0 THEN 0 ELSE l_orderkey END AS ok,
    CASE WHEN l_partkey % 3 = 0 THEN 0 ELSE l_partkey END AS pk,
    CASE WHEN l_partkey % 3 = 0 THEN 0 ELSE l_suppkey END AS sk,
    CASE WHEN l_partkey % 3 = 0 THEN 0 ELSE l_linenumber END AS ln,
    CASE WHEN l_partkey % 3 = 0 THEN 'A' ELSE l_returnflag END AS flag,
    CASE WHEN l_partkey % 3 = 0 THEN 7 ELSE CAST(l_quantity AS BIGINT) END AS qty,
    CASE WHEN l_partkey % 3 = 0 THEN DATE '1998-01-05' ELSE CAST(l_shipdate AS DATE) END AS day
  FROM lineitem)
"""

CLAIMS_COLUMNS = ("claim_id", "plan", "service_date", "paid_amount", "icd_code", "ndc",
                  "accepted_flag", "gender", "notes")


def messy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(MESSY.replace("FROM customer", "FROM {customer}"),
                     customer=table(spark, sf_dir, "customer"))


_CLAIM_SOURCE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_shipdate")


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(CLAIMS.replace("FROM lineitem", "FROM {lineitem}"),
                     lineitem=table(spark, sf_dir, "lineitem").select(*_CLAIM_SOURCE))


def segment_messy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messy view split into one dataset per market segment."""
    df = table(spark, sf_dir, "customer")
    return spark.sql(MESSY.replace("FROM customer", "FROM {customer}")
                     .replace("SELECT c_custkey AS row_id,",
                              "SELECT c_mktsegment AS dataset_id, c_custkey AS row_id,"),
                     customer=df)


SEGMENT_MESSY = MESSY.replace("SELECT c_custkey AS row_id,",
                              "SELECT c_mktsegment AS dataset_id, c_custkey AS row_id,")
