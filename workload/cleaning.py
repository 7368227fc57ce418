"""Names, missing values, formats, coercion, duplicates and privacy."""

from __future__ import annotations

from pyspark.sql import functions as F

from claritable import rules
from claritable.functions import coerce, pii, text
from claritable.operators import columns, dedup, privacy, qc
from claritable.operators.cells import COLUMN, DATASET
from claritable.options import CleanOptions
from claritable.plans.cleaning import column_specs, fit, measure_conversion
from workload import sql
from workload.inputs import AS_OF, CLAIMS_COLUMNS, MESSY_COLUMNS, claims, messy, table
from workload.registry import query

M, C = sql.WITH_MESSY, sql.WITH_CLAIMS

# Hints of the messy view, as an override of what the profile would infer.
MESSY_HINTS = {
    "patient_id": ("string", "id"), "dob": ("date", "dob"), "visit_date": ("date", "encounter_date"),
    "paid_amount": ("number", None), "icd_code": ("string", "code"), "cpt": ("string", "code"),
    "hcpcs": ("string", "code"), "loinc": ("string", "code"), "ndc": ("string", "code"),
    "rxnorm": ("string", "code"), "npi": ("string", "provider"), "phone": ("string", "phone"),
    "email": ("string", "email"), "zip": ("string", "postal_code"), "gender": ("string", "gender"),
    "consent_flag": ("boolean", "boolean"), "patient_name": ("string", "id"),
}
CLAIMS_HINTS = {
    "claim_id": ("string", "id"), "plan": ("string", "payer"), "service_date": ("date", "encounter_date"),
    "paid_amount": ("number", None), "icd_code": ("string", "code"), "ndc": ("string", "code"),
    "accepted_flag": ("boolean", "boolean"), "gender": ("string", "gender"),
}


def _per_column(make) -> str:
    return ", ".join(f"{make(c)} AS {c}" for c in MESSY_COLUMNS)


@query("normalize_missing", f"{M} SELECT row_id, {_per_column(sql.norm)} FROM messy")
def _(spark, sf):
    return messy(spark, sf).select("row_id", *[text.normalize_missing(F.col(c)).alias(c) for c in MESSY_COLUMNS])


@query("sanitize_text", f"{M} SELECT row_id, {_per_column(lambda c: sql.collapse(sql.norm(c)))} FROM messy")
def _(spark, sf):
    return messy(spark, sf).select("row_id", *[
        text.collapse(text.normalize_missing(F.col(c))).alias(c) for c in MESSY_COLUMNS])


_TITLE = (r"array_to_string(list_transform(regexp_extract_all({c}, '\p{{L}}+|[^\p{{L}}]+'), "
          r"lambda s: upper(s[1]) || lower(s[2:])), '')")
for _case, _sql in (("lower", "lower({c})"), ("upper", "upper({c})"), ("title", _TITLE)):
    def _cased(spark, sf, case=_case):
        return messy(spark, sf).select("row_id", *[
            text.text_case(F.col(c), case).alias(c) for c in ("notes", "patient_name", "email")])
    query(f"text_case_{_case}", f"{M} SELECT row_id, " + ", ".join(
        f"{_sql.format(c=c)} AS {c}" for c in ("notes", "patient_name", "email")) + " FROM messy")(_cased)

for _name, _column, _expr, _check in (
        ("normalize_phone", "phone", text.normalize_phone, sql.phone),
        ("normalize_postal", "zip", text.normalize_postal, sql.postal),
        ("normalize_gender", "gender", text.normalize_gender, sql.gender),
        ("normalize_ndc", "ndc", text.normalize_ndc, sql.ndc),
        ("normalize_rxnorm", "rxnorm", text.normalize_rxnorm, sql.rxnorm),
        ("compact_code", "icd_code", text.compact_code, sql.compact),
        ("zip3", "zip", text.zip3, sql.zip3)):
    def _formatted(spark, sf, column=_column, expr=_expr):
        return messy(spark, sf).select("row_id", F.col(column).alias("before"), expr(F.col(column)).alias("after"))
    query(_name, f"{M} SELECT row_id, {_column} AS before, {_check(_column)} AS after FROM messy")(_formatted)


# --- names ------------------------------------------------------------------
_HEADERS = ("Row ID", " Claim ID ", "Plan", "Service-Date", "Paid Amount ($)", "ICD Code", "icd_code",
            "Accepted?", "Sex/Gender", "###")
_CLEANED = ("row_id", "claim_id", "plan", "service_date", "paid_amount", "icd_code", "icd_code_2",
            "accepted", "sex_gender", "column")


@query("standardize_columns", f"{C} SELECT " + ", ".join(
    f'{a} AS "{b}"' for a, b in zip(("row_id",) + CLAIMS_COLUMNS, _CLEANED)) + " FROM claims")
def _(spark, sf):
    return columns.standardize_columns(claims(spark, sf).toDF(*_HEADERS))


# Every part is a small dataset whose columns are the words of its name and type.
_CATALOG = """
SELECT CAST(p_partkey AS STRING) AS dataset_id, 0 AS position, p_name AS name FROM part
UNION ALL SELECT CAST(p_partkey AS STRING), 1, ' ' || p_type || '!' FROM part
UNION ALL SELECT CAST(p_partkey AS STRING), 2, upper(p_name) FROM part
UNION ALL SELECT CAST(p_partkey AS STRING), 3, p_brand FROM part
UNION ALL SELECT CAST(p_partkey AS STRING), 4, replace(p_name, ' ', '--') FROM part
UNION ALL SELECT CAST(p_partkey AS STRING), 5, '(%)' FROM part"""


def catalog(spark, sf):
    return spark.sql(_CATALOG.replace("FROM part", "FROM {part}"), part=table(spark, sf, "part"))


@query("standardize_catalog", rf"""
WITH catalog AS ({_CATALOG}),
base AS (SELECT *, CASE WHEN b = '' THEN 'column' ELSE b END AS base FROM (
  SELECT *, lower(trim(regexp_replace(name, '[^a-zA-Z0-9]+', '_', 'g'), '_')) AS b FROM catalog)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY dataset_id, base ORDER BY position) AS n FROM base)
SELECT dataset_id, position, name AS original_name,
  CASE WHEN n = 1 THEN base ELSE base || '_' || n END AS clean_name FROM numbered""")
def _(spark, sf):
    return columns.standardize_catalog(catalog(spark, sf))


def _messy_plan_columns(spark, sf, **changes):
    df = messy(spark, sf)
    options = CleanOptions(as_of=AS_OF, **changes)
    specs = column_specs(df.columns, MESSY_HINTS, options, ("row_id",))
    return measure_conversion(df, specs, options, "messy")


def _counts(columns_=MESSY_COLUMNS, view="messy") -> str:
    """Non-missing cells per column."""
    return (f"SELECT position, column_name, count({sql.norm('value')}) AS non_null, count(*) AS row_count "
            f"FROM ({sql.cells(view, columns_)}) GROUP BY position, column_name")


@query("drop_empty_columns", f"{M} SELECT column_name, non_null, non_null = 0 AS dropped_empty FROM ({_counts()})")
def _(spark, sf):
    return _messy_plan_columns(spark, sf).select(COLUMN, "non_null", "dropped_empty")


@query("column_roles", f"""{M} SELECT column_name, non_null,
 {sql.any_token('column_name', rules.PII_COLUMN_TOKENS)} AS is_pii,
 {sql.any_token('column_name', rules.PROTECTED_NAME_TOKENS)} AS is_protected,
 NOT {sql.any_token('column_name', rules.NON_TEXT_NAME_TOKENS)} AS is_open_text FROM ({_counts()})""")
def _(spark, sf):
    return columns.column_roles(_messy_plan_columns(spark, sf).select(COLUMN, "non_null"), COLUMN)


@query("hint_fallback", f"""WITH catalog AS ({_CATALOG}), names AS (
 SELECT dataset_id, position, name FROM catalog
 UNION ALL SELECT CAST(c_custkey AS STRING), 10, c_mktsegment || '_zip' FROM customer
 UNION ALL SELECT CAST(c_custkey AS STRING), 11, CASE WHEN c_custkey % 2 = 0 THEN 'home_phone' ELSE 'Sex' END FROM customer)
SELECT dataset_id, position, name, {sql.hint('lower(name)', rules.FALLBACK_HINTS)} AS fallback_hint,
 {sql.hint('lower(name)')} AS semantic_hint FROM names""")
def _(spark, sf):
    customers = table(spark, sf, "customer")
    key = F.col("c_custkey")
    extra = customers.select(
        key.cast("string").alias(DATASET), F.lit(10).alias("position"),
        F.concat("c_mktsegment", F.lit("_zip")).alias("name")).unionByName(customers.select(
            key.cast("string").alias(DATASET), F.lit(11).alias("position"),
            F.when(key % 2 == 0, "home_phone").otherwise("Sex").alias("name")))
    return columns.name_hints(catalog(spark, sf).unionByName(extra), "name").drop("domain_tags")


@query("column_renames", rf"""WITH catalog AS ({_CATALOG}),
base AS (SELECT dataset_id, position, name, CASE WHEN b = '' THEN 'column' ELSE b END AS base FROM (
  SELECT *, lower(trim(regexp_replace(name, '[^a-zA-Z0-9]+', '_', 'g'), '_')) AS b FROM catalog)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY dataset_id, base ORDER BY position) AS n FROM base),
clean AS (SELECT dataset_id, position, name, CASE WHEN n = 1 THEN base ELSE base || '_' || n END AS clean FROM numbered)
SELECT dataset_id, CAST(row_number() OVER (PARTITION BY dataset_id ORDER BY position) AS INT) AS "rank",
 name AS "from", clean AS "to" FROM clean WHERE name <> clean""")
def _(spark, sf):
    named = columns.standardize_catalog(catalog(spark, sf)).withColumnRenamed("clean_name", COLUMN)
    return qc.column_renames(named)


# --- coercion ---------------------------------------------------------------
_TYPED = {
    "number": ("paid_amount", coerce.number, coerce.number_to_text, sql.number, lambda c: sql.number_text(sql.number(c))),
    "date": ("dob", lambda c: coerce.date(c, AS_OF), coerce.date_to_text,
             lambda c: f"CAST({sql.timestamp(c)} AS DATE)", sql.date_text),
    "bool": ("consent_flag", coerce.boolean, lambda c: c.cast("string"), sql.boolean,
             lambda c: f"CAST({sql.boolean(c)} AS VARCHAR)"),
}
for _kind, (_column, _read, _write, _sql_read, _sql_write) in _TYPED.items():
    _n = f"({sql.norm(_column)})"

    def _strict(spark, sf, column=_column, read=_read, write=_write):
        raw = text.normalize_missing(F.col(column))
        return messy(spark, sf).select("row_id", write(read(raw)).alias("value"))

    def _safe(spark, sf, column=_column, read=_read, write=_write):
        raw = text.normalize_missing(F.col(column))
        return messy(spark, sf).select("row_id", F.coalesce(write(read(raw)), text.collapse(raw)).alias("value"))

    query(f"coerce_{_kind}_strict", f"{M} SELECT row_id, {_sql_write(_n)} AS value FROM messy")(_strict)
    query(f"coerce_{_kind}_safe",
          f"{M} SELECT row_id, coalesce({_sql_write(_n)}, {sql.collapse(_n)}) AS value FROM messy")(_safe)


_FORMS = ("M/d/yyyy h:mm a", "yyyy-MM-dd hh:mm a", "MMM d, yyyy h:mm a", "EEE, dd MMM yyyy", "yyyyMMdd'T'HHmmss", "yyyy-MM",
          "EEEE, MMMM d, yyyy")


@query("coerce_date_forms", """SELECT o_orderkey AS row_id, strftime(CASE o_orderkey % 7
 WHEN 3 THEN date_trunc('day', m) WHEN 6 THEN date_trunc('day', m) WHEN 5 THEN date_trunc('month', m) ELSE m END, '%Y-%m-%d %H:%M')
 AS moment FROM (SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) + to_minutes(o_orderkey % 1440) AS m FROM orders)""")
def _(spark, sf):
    orders = table(spark, sf, "orders")
    moment = F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(mins=F.col("o_orderkey") % 1440)
    written = F.array(*[F.date_format("m", form) for form in _FORMS])
    rows = orders.select("o_orderkey", moment.alias("m")).select(
        F.col("o_orderkey").alias("row_id"), F.get(written, F.col("o_orderkey") % len(_FORMS)).alias("text"))
    return rows.select("row_id", F.date_format(coerce.timestamp(F.col("text"), AS_OF), "yyyy-MM-dd HH:mm").alias("moment"))


@query("coerce_claim_dates", f"""{C} SELECT row_id, service_date, {sql.date_text('service_date')} AS service_day,
 count(*) AS copies FROM claims GROUP BY ALL""")
def _(spark, sf):
    return claims(spark, sf).groupBy("row_id", "service_date").agg(F.count(F.lit(1)).alias("copies")).select(
        "row_id", "service_date", coerce.date_to_text(coerce.date(F.col("service_date"), AS_OF)).alias("service_day"),
        "copies")


_PARSED = {
    "dob": f"count({sql.timestamp(sql.norm('dob'))})", "visit_date": f"count({sql.timestamp(sql.norm('visit_date'))})",
    "paid_amount": f"count({sql.number('(' + sql.norm('paid_amount') + ')')})",
    "consent_flag": f"count({sql.boolean('(' + sql.norm('consent_flag') + ')')})"}
_TARGET = {"dob": "date", "visit_date": "date", "paid_amount": "number", "consent_flag": "boolean"}


def gate_sql(mode: str, with_messy: str = M) -> str:
    parts = []
    for i, c in enumerate(MESSY_COLUMNS):
        parsed = _PARSED.get(c)
        kind = _TARGET.get(c)
        own = "safe" if c in ("dob", "visit_date") else mode
        parts.append(
            f"SELECT {i} AS position, {sql.quote(c)} AS column_name, count({sql.norm(c)}) AS non_null, "
            f"{parsed or 'NULL'} AS parsed, {sql.quote(kind) if kind else 'NULL'} AS wanted, "
            f"{sql.quote(own)} AS own_mode FROM messy")
    return f"""{with_messy}, measured AS ({' UNION ALL '.join(parts)})
SELECT column_name, non_null, CASE WHEN wanted IS NULL THEN 0 ELSE non_null - parsed END AS invalid,
 CASE WHEN wanted IS NOT NULL THEN round_even(parsed::DOUBLE / non_null, 3) END AS success_ratio,
 CASE WHEN wanted IS NULL OR parsed::DOUBLE / non_null < 0.6 THEN 'string' ELSE wanted END AS target_type,
 CASE WHEN wanted IS NOT NULL AND parsed::DOUBLE / non_null >= 0.6 THEN own_mode END AS coercion_mode,
 wanted IS NOT NULL AND parsed::DOUBLE / non_null < 0.6 AS coercion_skipped FROM measured"""


for _mode in ("safe", "strict"):
    def _gated(spark, sf, mode=_mode):
        return _messy_plan_columns(spark, sf, coercion=mode).select(
            COLUMN, "non_null", "invalid", "success_ratio", "target_type", "coercion_mode", "coercion_skipped")
    query("coercion_gate" if _mode == "safe" else "critical_dates", gate_sql(_mode))(_gated)


@query("conversion_summary", f"""SELECT count(*) AS columns, count(*) FILTER (target_type = 'string') AS string_columns,
 count(*) FILTER (target_type = 'number') AS number_columns, count(*) FILTER (target_type = 'date') AS date_columns,
 count(*) FILTER (target_type = 'boolean') AS boolean_columns, CAST(sum(invalid) AS BIGINT) AS invalid_total
FROM ({gate_sql('safe')})""")
def _(spark, sf):
    return qc.conversion_summary(_messy_plan_columns(spark, sf)).drop(DATASET, "invalid_columns", "skipped_columns")


@query("normalization_summary", f"""SELECT count(*) FILTER (target_type <> 'string') AS typed_count,
 string_agg(column_name, ',' ORDER BY column_name) FILTER (target_type <> 'string') AS typed_columns,
 string_agg(column_name, ',' ORDER BY column_name) FILTER (column_name IN ('patient_id', 'phone', 'email', 'patient_name')) AS masked,
 string_agg(column_name, ',' ORDER BY column_name) FILTER (column_name IN ('dob', 'visit_date')) AS generalized
FROM ({gate_sql('safe')})""")
def _(spark, sf):
    joined = lambda c: F.array_join(F.sort_array(c), ",")
    return qc.normalization_summary(_messy_plan_columns(spark, sf, privacy="safe_harbor"), "safe_harbor").select(
        "typed_count", joined("typed_columns").alias("typed_columns"),
        joined("columns_masked").alias("masked"), joined("dates_generalized").alias("generalized"))


# --- whole cleans -----------------------------------------------------------
def _safe_text(write, c: str) -> str:
    n = f"({sql.norm(c)})"
    return f"coalesce({write(n)}, {sql.collapse(n)})"


CLEAN_CLAIMS = {
    "claim_id": sql.collapse(sql.norm("claim_id")), "plan": sql.collapse(sql.norm("plan")),
    "service_date": _safe_text(sql.date_text, "service_date"),
    "paid_amount": _safe_text(lambda n: sql.number_text(sql.number(n)), "paid_amount"),
    "icd_code": sql.compact(sql.collapse(sql.norm("icd_code"))),
    "ndc": sql.ndc(f"({sql.compact(sql.collapse(sql.norm('ndc')))})"),
    "accepted_flag": sql.boolean(f"({sql.norm('accepted_flag')})"),
    "gender": sql.gender(f"({sql.collapse(sql.norm('gender'))})"),
    "notes": sql.collapse(sql.norm("notes")),
}
CLEAN_CLAIMS_SQL = "SELECT DISTINCT " + ", ".join(f"{e} AS {c}" for c, e in CLEAN_CLAIMS.items()) + " FROM claims"


def claims_plan(spark, sf, **changes):
    return fit(claims(spark, sf), CleanOptions(as_of=AS_OF, **changes), hints=CLAIMS_HINTS,
               exclude=("row_id",), dataset="claims")


def clean_claims(spark, sf):
    return claims_plan(spark, sf).clean(claims(spark, sf))


@query("clean_table", f"{C} {CLEAN_CLAIMS_SQL}")
def _(spark, sf):
    return clean_claims(spark, sf)


CLEAN_MESSY = {
    "patient_id": sql.collapse(sql.norm("patient_id")), "dob": _safe_text(sql.date_text, "dob"),
    "visit_date": sql.date_text("(" + sql.norm("visit_date") + ")"),
    "paid_amount": _safe_text(lambda n: sql.number_text(sql.number(n)), "paid_amount"),
    **{c: sql.compact(sql.collapse(sql.norm(c))) for c in ("icd_code", "cpt", "hcpcs", "loinc")},
    "ndc": sql.ndc(f"({sql.collapse(sql.norm('ndc'))})"),
    "rxnorm": sql.rxnorm(f"({sql.collapse(sql.norm('rxnorm'))})"),
    "npi": sql.collapse(sql.norm("npi")), "phone": sql.phone(f"({sql.norm('phone')})"),
    "email": sql.collapse(sql.norm("email")), "zip": sql.postal(f"({sql.norm('zip')})"),
    "gender": sql.gender(f"({sql.collapse(sql.norm('gender'))})"),
    "consent_flag": _safe_text(lambda n: f"CAST({sql.boolean(n)} AS VARCHAR)", "consent_flag"),
    "patient_name": sql.collapse(sql.norm("patient_name")), "notes": sql.collapse(sql.norm("notes")),
}
CLEAN_MESSY_SQL = "SELECT row_id, " + ", ".join(f"{e} AS {c}" for c, e in CLEAN_MESSY.items()) + " FROM messy"


def messy_plan(spark, sf, **changes):
    return fit(messy(spark, sf), CleanOptions(as_of=AS_OF, **changes), hints=MESSY_HINTS,
               exclude=("row_id",), dataset="messy")


def clean_messy(spark, sf):
    return messy_plan(spark, sf).clean(messy(spark, sf), "row_id")


@query("clean_with_key", f"{M} {CLEAN_MESSY_SQL}")
def _(spark, sf):
    cleaned = clean_messy(spark, sf)
    return cleaned.withColumn("visit_date", coerce.date_to_text(F.col("visit_date")))


@query("clean_ultra_fast", f"{M} SELECT row_id, " + ", ".join(
    f"{e} AS {c}" for c, e in {
        "patient_id": sql.norm("patient_id"), "dob": f"coalesce({sql.date_text('(' + sql.norm('dob') + ')')}, {sql.norm('dob')})",
        "visit_date": sql.date_text("(" + sql.norm("visit_date") + ")"), "paid_amount": sql.norm("paid_amount"),
        "phone": sql.norm("phone"), "zip": sql.norm("zip"), "gender": sql.norm("gender"),
        "ndc": sql.ndc(f"({sql.norm('ndc')})"), "notes": sql.norm("notes")}.items()) + " FROM messy")
def _(spark, sf):
    cleaned = messy_plan(spark, sf, performance="ultra_fast", remove_duplicates=False).clean(messy(spark, sf), "row_id")
    return cleaned.select("row_id", "patient_id", "dob", coerce.date_to_text(F.col("visit_date")).alias("visit_date"),
                          "paid_amount", "phone", "zip", "gender", "ndc", "notes")


# --- duplicates -------------------------------------------------------------
@query("dedup_rows", "SELECT DISTINCT text, lang FROM documents")
def _(spark, sf):
    return dedup.drop_duplicates(table(spark, sf, "documents").select("text", "lang"))


@query("dedup_keep_first", f"""{C} SELECT min(row_id) AS row_id, {', '.join(CLAIMS_COLUMNS)}
FROM claims GROUP BY {', '.join(CLAIMS_COLUMNS)}""")
def _(spark, sf):
    return dedup.drop_duplicates(claims(spark, sf), keep_first="row_id")


def _rate(view: str, columns_: str, by: str) -> str:
    return f"""SELECT {by} AS dataset_id, CAST(sum(n) AS BIGINT) AS row_count,
 CAST(sum(n) - count(*) AS BIGINT) AS duplicate_rows,
 CAST(sum(n) - count(*) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS duplicate_rate
FROM (SELECT {by}, {columns_}, count(*) AS n FROM {view} GROUP BY {by}, {columns_}) GROUP BY {by}"""


@query("duplicate_rate", f"{C} {_rate('claims', ', '.join(c for c in CLAIMS_COLUMNS if c != 'plan'), 'plan')}")
def _(spark, sf):
    return dedup.duplicate_rate(claims(spark, sf).drop("row_id"), group="plan")


@query("duplicate_rate_documents", _rate("documents", "text", "source"))
def _(spark, sf):
    return dedup.duplicate_rate(table(spark, sf, "documents").select("source", "text"), group="source")


# --- privacy ----------------------------------------------------------------
@query("redact_text", f"SELECT doc_id, {sql.redact('text')} AS text FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", pii.redact(F.col("text")).alias("text"))


@query("redact_conversations", f"SELECT conv_id, turn, {sql.redact('text')} AS text FROM conversations")
def _(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", pii.redact(F.col("text")).alias("text"))


@query("redact_for_retrieval", f"SELECT conv_id, turn, {sql.collapse(sql.redact(sql.strip('text')))} AS text FROM conversations")
def _(spark, sf):
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", pii.retrieval_text(F.col("text")).alias("text"))


@query("redact_columns", f"{M} SELECT row_id, " + ", ".join(
    f"CASE WHEN {c} IS NOT NULL THEN '[redacted_name]' END AS {c}" if "name" in c else f"{sql.redact(c)} AS {c}"
    for c in MESSY_COLUMNS) + " FROM messy")
def _(spark, sf):
    return privacy.redact_columns(messy(spark, sf), keep=("row_id",))


def _year(c: str, birth: bool) -> str:
    year = f"year({sql.timestamp(c)})"
    out = f"CAST({year} AS VARCHAR)"
    if birth:
        out = f"CASE WHEN {AS_OF.year} - {year} > 89 THEN '90+' ELSE {out} END"
    return f"CASE WHEN {c} IS NULL THEN NULL ELSE coalesce({out}, '[redacted_date]') END"


_HARBOR = {
    "patient_id": "'[redacted_id]'", "dob": _year("dob", True), "visit_date": _year("visit_date", False),
    "phone": "'[redacted_phone]'", "email": "'[redacted_email]'", "zip": sql.zip3("zip"),
    "patient_name": "'[redacted_name]'"}
HARBOR_HINTS = {k: v[1] for k, v in MESSY_HINTS.items()}


@query("safe_harbor", f"{M} SELECT row_id, " + ", ".join(
    f"{_HARBOR.get(c, c)} AS {c}" for c in MESSY_COLUMNS) + " FROM messy")
def _(spark, sf):
    return privacy.safe_harbor(messy(spark, sf), HARBOR_HINTS, AS_OF, keep=("row_id",))


@query("generalize_dates", f"{M}, n AS (SELECT row_id, {sql.norm('dob')} AS dob, {sql.norm('visit_date')} AS visit_date FROM messy) "
       f"SELECT row_id, {_year('dob', True)} AS birth_year, {_year('visit_date', False)} AS visit_year FROM n")
def _(spark, sf):
    from pyspark.sql.types import StringType
    clean = lambda c: text.normalize_missing(F.col(c))
    return messy(spark, sf).select(
        "row_id",
        privacy.generalize_date(clean("dob"), StringType(), birth=True, as_of=AS_OF).alias("birth_year"),
        privacy.generalize_date(clean("visit_date"), StringType(), birth=False, as_of=AS_OF).alias("visit_year"))


@query("privacy_report", f"""{M} SELECT column_name, non_null, CASE
 WHEN column_name IN ('patient_id', 'phone', 'email', 'patient_name') THEN 'columns_masked'
 WHEN column_name = 'zip' THEN 'zip_truncated' ELSE 'dates_generalized' END AS transform
FROM ({_counts()}) WHERE column_name IN ('patient_id','phone','email','patient_name','zip','dob','visit_date')""")
def _(spark, sf):
    named = _messy_plan_columns(spark, sf).withColumn("clean_name", F.col(COLUMN))
    return privacy.privacy_report(named).select(COLUMN, "non_null", "transform")


@query("clean_private", f"{M}, cleaned AS ({CLEAN_MESSY_SQL}) SELECT row_id, " + ", ".join(
    f"{e} AS {c}" for c, e in {
        "patient_id": "'[redacted_id]'",
        "dob": _year(f"({sql.redact('dob')})", True), "visit_date": "left(visit_date, 4)",
        "paid_amount": sql.redact("paid_amount"), "npi": sql.redact("npi"), "ndc": sql.redact("ndc"),
        "phone": "'[redacted_phone]'", "email": "'[redacted_email]'", "zip": sql.zip3(f"({sql.redact('zip')})"),
        "patient_name": "'[redacted_name]'", "notes": sql.redact("notes")}.items()) + " FROM cleaned")
def _(spark, sf):
    plan = messy_plan(spark, sf, deidentify=True, privacy="safe_harbor")
    return plan.clean(messy(spark, sf), "row_id").select(
        "row_id", "patient_id", "dob", "visit_date", "paid_amount", "npi", "ndc", "phone", "email", "zip",
        "patient_name", "notes")


def _pii(c: str) -> str:
    return ", ".join(f"count(*) FILTER ({sql.matches(c, p)}) AS {n}" for n, p in (
        ("emails", rules.EMAIL), ("phones", rules.PHONE), ("ssns", rules.SSN)))


@query("pii_counts", f"""SELECT 'documents' AS dataset_id, lang AS part, {_pii('text')} FROM documents GROUP BY lang
UNION ALL SELECT 'conversations', role, {_pii('text')} FROM conversations GROUP BY role""")
def _(spark, sf):
    def counted(name, part):
        c = F.col("text")
        return table(spark, sf, name).groupBy(F.lit(name).alias(DATASET), F.col(part).alias("part")).agg(
            F.count_if(pii.has_email(c)).alias("emails"), F.count_if(pii.has_phone(c)).alias("phones"),
            F.count_if(pii.has_ssn(c)).alias("ssns"))
    return counted("documents", "lang").unionByName(counted("conversations", "role"))


@query("document_readout", f"""WITH d AS (SELECT lang, text, {sql.collapse(sql.norm('text'))} AS clean FROM documents)
SELECT lang, count(*) AS docs, count(*) FILTER ({sql.matches('clean', rules.EMAIL)}) AS docs_with_email,
 count(*) FILTER ({sql.redact('clean')} <> text) AS docs_changed,
 CAST(sum(length({sql.redact('clean')})) AS BIGINT) AS total_length FROM d GROUP BY lang""")
def document_readout(spark, sf):
    """Flagship: clean and redact every document, then report per language."""
    clean = text.collapse(text.normalize_missing(F.col("text")))
    staged = table(spark, sf, "documents").select("lang", "text", clean.alias("clean"))
    staged = staged.withColumn("redacted", pii.redact(F.col("clean")))
    return staged.groupBy("lang").agg(
        F.count(F.lit(1)).alias("docs"), F.count_if(pii.has_email(F.col("clean"))).alias("docs_with_email"),
        F.count_if(F.col("redacted") != F.col("text")).alias("docs_changed"),
        F.sum(F.length("redacted")).alias("total_length"))
