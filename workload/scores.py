"""Validation, before/after reports, readiness of the data, outcomes and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from claritable import rules
from claritable.operators import dedup, outcomes, profile, qc, readiness, validate
from claritable.operators.cells import COLUMN, DATASET
from claritable.options import CleanOptions
from claritable.plans.runs import clean_run, duplicates_left, invalid_totals, precheck
from claritable.sources.scratch import materialize
from workload import sql
from workload.cleaning import (
    CLAIMS_HINTS,
    CLEAN_CLAIMS,
    CLEAN_CLAIMS_SQL,
    CLEAN_MESSY_SQL,
    HARBOR_HINTS,
    claims_plan,
    clean_messy,
    messy_plan,
)
from workload.inputs import AS_OF, CLAIMS_COLUMNS, MESSY_COLUMNS, claims, messy, segment_messy, table
from workload.profiles import BAND, BEFORE, checks_sql, profile_ctes
from workload.registry import query

M, C = sql.WITH_MESSY, sql.WITH_CLAIMS

# --- validation -------------------------------------------------------------
_TODAY = f"TIMESTAMP '{AS_OF.isoformat()} 00:00:00'"


def failing(issue: str, column: str) -> str:
    if issue == "dob_future":
        return f"{sql.timestamp(column)} > {_TODAY}"
    if issue == "date_future":
        return f"{sql.timestamp(column)} > {_TODAY} + INTERVAL 1 DAY"
    if issue == "negative_amount":
        return f"({sql.plain_number(column)}) < 0"
    pattern = next(p for i, _, p, _ in rules.CODE_RULES if i == issue)
    return f"{column} IS NOT NULL AND NOT {sql.matches(column, pattern)}"


MESSY_RULES = (("dob_future", "dob"), ("date_future", "visit_date"), ("invalid_icd10", "icd_code"),
               ("invalid_cpt", "cpt"), ("invalid_hcpcs", "hcpcs"), ("invalid_loinc", "loinc"),
               ("invalid_ndc", "ndc"), ("invalid_rxnorm", "rxnorm"), ("invalid_npi", "npi"),
               ("negative_amount", "paid_amount"))


def _counted(view: str, rule_list, by: str = "", dataset: str = "'messy'") -> str:
    group = f" GROUP BY {by}" if by else ""
    return " UNION ALL ".join(
        f"SELECT {by or dataset} AS dataset_id, '{issue}' AS issue_type, '{column}' AS column_name, "
        f"count(*) FILTER ({failing(issue, column)}) AS count, count(*) AS row_count FROM {view}{group}"
        for issue, column in rule_list)


for _issue, _column in MESSY_RULES:
    def _validated(spark, sf, issue=_issue):
        return validate.rule_counts(messy(spark, sf), HARBOR_HINTS, AS_OF, dataset="messy", only=(issue,),
                                    exclude=("row_id",)).select(DATASET, "issue_type", COLUMN, "count", "row_count")
    query(f"validate_{_issue}", f"{M} {_counted('messy', [(_issue, _column)])}")(_validated)


@query("validate_typed_amounts", """SELECT c_mktsegment AS dataset_id, 'negative_amount' AS issue_type,
 'account_amount' AS column_name, count(*) FILTER (c_acctbal < 0) AS count, count(*) AS row_count FROM customer GROUP BY 1""")
def _(spark, sf):
    typed = table(spark, sf, "customer").select("c_mktsegment", F.col("c_acctbal").alias("account_amount"))
    return validate.rule_counts(typed, {}, AS_OF, dataset=F.col("c_mktsegment"), exclude=("c_mktsegment",)).select(
        DATASET, "issue_type", COLUMN, "count", "row_count")


def _severity(counted: str) -> str:
    weights = " ".join(f"WHEN '{k}' THEN {v}" for k, v in rules.ISSUE_WEIGHTS.items())
    order = " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(rules.ISSUE_WEIGHTS))
    r = {k: sql.quote(v) for k, v in rules.SEVERITY_REASONS.items()}
    return f"""rated AS (SELECT *, CAST(CASE issue_type {weights} END AS DOUBLE) AS impact_weight,
  CASE issue_type {order} END AS rule_order, count::DOUBLE / row_count * 100 AS rate FROM ({counted}) WHERE count > 0),
graded AS (SELECT *, rate * impact_weight AS score, CASE WHEN issue_type = 'dob_future' OR rate * impact_weight >= 15
  THEN 'high' WHEN rate * impact_weight >= 5 THEN 'medium' ELSE 'low' END AS severity FROM rated),
issues AS (SELECT dataset_id, rule_order, issue_type, column_name, count, row_count, severity, impact_weight,
  round_even(rate, 3) AS rate_pct, round_even(score, 3) AS severity_score,
  CASE WHEN issue_type = 'dob_future' THEN {r['critical']} WHEN severity = 'high' THEN {r['high']}
   WHEN severity = 'medium' THEN {r['medium']} ELSE {r['low']} END AS reason FROM graded)"""


_SEGMENT_ISSUES = f"{sql.WITH_SEGMENTS}, {_severity(_counted('messy', MESSY_RULES, 'dataset_id'))}"


def segment_issues(spark, sf):
    return validate.issues(segment_messy(spark, sf), HARBOR_HINTS, AS_OF, dataset=F.col(DATASET),
                           exclude=(DATASET, "row_id"))


@query("issue_severity", f"{_SEGMENT_ISSUES} SELECT * EXCLUDE (rule_order) FROM issues")
def _(spark, sf):
    return segment_issues(spark, sf).drop("rule_order", "message")


@query("severity_summary", f"""{_SEGMENT_ISSUES} SELECT dataset_id, count(*) FILTER (severity = 'high') AS high,
 count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low, count(*) AS total
FROM issues GROUP BY dataset_id""")
def _(spark, sf):
    return validate.severity_counts(segment_issues(spark, sf))


@query("top_issues", f"""{_SEGMENT_ISSUES} SELECT dataset_id, issue_type, column_name, severity, count, rate_pct, place FROM (
 SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC,
  severity_score DESC, count DESC, rule_order, column_name) AS place FROM issues) WHERE place <= 5""")
def _(spark, sf):
    return validate.top_issues(segment_issues(spark, sf)).select(
        DATASET, "issue_type", COLUMN, "severity", "count", "rate_pct", F.col("rank").alias("place"))


_CLEAN_RULES = (("date_future", "service_date"), ("invalid_icd10", "icd_code"), ("invalid_ndc", "ndc"),
                ("negative_amount", "paid_amount"))
_CLEANED = f"{C}, cleaned AS ({CLEAN_CLAIMS_SQL})"


@query("issues_after_clean", f"""{_CLEANED}, {_severity(_counted('cleaned', _CLEAN_RULES, dataset="'claims'"))}
SELECT issue_type, column_name, count, row_count, severity, rate_pct FROM issues""")
def _(spark, sf):
    plan = claims_plan(spark, sf)
    return validate.issues(plan.clean(claims(spark, sf)), plan.hints, AS_OF, dataset="claims").select(
        "issue_type", COLUMN, "count", "row_count", "severity", "rate_pct")


# --- before and after -------------------------------------------------------
@query("qc_rows", f"""{_CLEANED} SELECT (SELECT count(*) FROM claims) AS row_count_raw,
 (SELECT count(*) FROM cleaned) AS row_count_cleaned,
 (SELECT count(*) FROM claims) - (SELECT count(*) FROM cleaned) AS rows_removed""")
def _(spark, sf):
    plan = claims_plan(spark, sf)
    raw = claims(spark, sf)
    return qc.row_accounting(raw, plan.clean(raw), plan.conversion(spark), "claims").drop(
        DATASET, "empty_columns_removed")


def _missing(view: str, columns, typed=()) -> str:
    tokens = sql.quoted(rules.MISSING_TOKENS)
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, " + sql.pct(
            f"count(*) FILTER ({c} IS NULL" + ("" if c in typed else f" OR lower({sql.strip(c)}) IN ({tokens})") + ")",
            "count(*)") + f" AS pct FROM {view}" for c in columns)


_INVALID = {
    "service_date": f"count({sql.norm('service_date')}) - count({sql.timestamp('(' + sql.norm('service_date') + ')')})",
    "paid_amount": f"count({sql.norm('paid_amount')}) - count({sql.number('(' + sql.norm('paid_amount') + ')')})",
    "accepted_flag": f"count({sql.norm('accepted_flag')}) - count({sql.boolean('(' + sql.norm('accepted_flag') + ')')})",
}
_INVALID_ROWS = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, {_INVALID.get(c, '0 * count(*)')} AS invalid FROM claims" for c in CLAIMS_COLUMNS)
_QC = f"""raw_pct AS ({_missing('claims', CLAIMS_COLUMNS)}),
clean_pct AS ({_missing('cleaned', CLAIMS_COLUMNS, ('accepted_flag',))}), invalid_rows AS ({_INVALID_ROWS}),
qc AS (SELECT column_name, r.pct AS missing_pct_raw, c.pct AS missing_pct_cleaned, invalid
  FROM raw_pct r FULL JOIN clean_pct c USING (column_name) LEFT JOIN invalid_rows USING (column_name))"""


@query("qc_missing_before_after", f"{_CLEANED}, {_QC} SELECT * FROM qc")
def _(spark, sf):
    plan, raw = claims_plan(spark, sf), claims(spark, sf)
    report = plan.conversion(spark)
    return qc.qc_columns(raw, plan.clean(raw, "row_id"), report, dataset="claims", exclude=("row_id",),
                         before=qc.missing_at_fit(raw, report, ("row_id",))).drop(DATASET)


def _changes(cut: str = "") -> str:
    """Changed cells of every row, raw against cleaned."""
    dropped = ("empty_col",)
    after = {c: ("NULL" if c in dropped else f"c.{c}") for c in MESSY_COLUMNS}
    differs = {c: f"m.{c} IS DISTINCT FROM {a}" for c, a in after.items()}
    count = " + ".join(f"CAST({d} AS INT)" for d in differs.values())
    text = ", ".join(f"CASE WHEN {d} THEN '{c}: ' || coalesce(m.{c}, 'NULL') || ' > ' || coalesce({after[c]}, 'NULL') END"
                     for c, d in differs.items())
    return f"""SELECT row_id, {count} AS change_count, concat_ws(' | ', {text}) AS changes
FROM messy m JOIN cleaned c USING (row_id) {cut}"""


def _change_text():
    shown = lambda x: F.concat(x["column"], F.lit(": "), F.coalesce(x["before"], F.lit("NULL")), F.lit(" > "),
                               F.coalesce(x["after"], F.lit("NULL")))
    return F.array_join(F.transform("changes", shown), " | ").alias("changes")


_CLEANED_MESSY = f"{M}, cleaned AS ({CLEAN_MESSY_SQL})"


@query("row_changes", f"{_CLEANED_MESSY} {_changes()}")
def _(spark, sf):
    return qc.row_changes(messy(spark, sf), clean_messy(spark, sf), "row_id", unique=True).select(
        "row_id", "change_count", _change_text())


@query("row_diff", f"{_CLEANED_MESSY} {_changes('ORDER BY row_id LIMIT 5')}")
def _(spark, sf):
    return qc.row_diff_sample(messy(spark, sf), clean_messy(spark, sf), "row_id", unique=True).select(
        "row_id", "change_count", _change_text())


@query("rows_removed_by_dedup", """SELECT doc_id, 'Only in the raw table.' AS note FROM documents
WHERE doc_id NOT IN (SELECT min(doc_id) FROM documents GROUP BY text, lang)""")
def _(spark, sf):
    raw = table(spark, sf, "documents").select("doc_id", "text", "lang")
    changes = qc.row_changes(raw, dedup.drop_duplicates(raw, keep_first="doc_id"), "doc_id", unique=True)
    return changes.filter(F.col("note").isNotNull()).select("doc_id", "note")


_OTHERS = [c for c in CLAIMS_COLUMNS if c != "claim_id"]
_TIES = ", ".join(f"{c} NULLS FIRST" for c in _OTHERS)  # row_id repeats too
_RANKED = f"row_number() OVER (PARTITION BY claim_id ORDER BY row_id, {_TIES}) AS occurrence"


@query("row_changes_repeated", f"""{C}, r AS (SELECT *, {_RANKED} FROM claims),
d AS (SELECT min(row_id) AS row_id, {', '.join(CLAIMS_COLUMNS)} FROM claims GROUP BY {', '.join(CLAIMS_COLUMNS)}),
c AS (SELECT *, {_RANKED} FROM d)
SELECT claim_id, occurrence, CASE WHEN c.row_id IS NULL THEN 'Only in the raw table.' END AS note,
 CASE WHEN c.row_id IS NULL THEN 0 ELSE {' + '.join(f"CAST(r.{c} IS DISTINCT FROM c.{c} AS INTEGER)" for c in _OTHERS)} END
 AS change_count FROM r LEFT JOIN c USING (claim_id, occurrence)""")
def _(spark, sf):
    """Claim numbers repeat, one of them in a third of all rows."""
    raw = claims(spark, sf)
    changes = qc.row_changes(raw, dedup.drop_duplicates(raw, keep_first="row_id"), "claim_id", "row_id")
    return changes.select("claim_id", "occurrence", "note", "change_count")


@query("change_summary", f"""{_CLEANED}, {_QC} SELECT 0 AS renamed_columns, 3 AS typed_columns, 0 AS cols_removed,
 count(*) AS changed_fields_count, CAST(sum(invalid) AS BIGINT) AS invalid_total,
 (SELECT count(*) FROM claims) - (SELECT count(*) FROM cleaned) AS rows_removed FROM qc""")
def _(spark, sf):
    plan, raw = claims_plan(spark, sf), claims(spark, sf)
    report = plan.conversion(spark)
    return qc.change_summary(report, qc.row_accounting(raw, plan.clean(raw), report, "claims")).drop(DATASET, "note")


# --- readiness of the data --------------------------------------------------
def after_ctes(view: str, columns, texts, invalid_total: str, tracked: int, dataset: str) -> str:
    """CTEs up to ``after_checks``: readiness measured on the rows of ``view``."""
    tokens = sql.quoted(rules.MISSING_TOKENS)
    name = "column_name"
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, {str(c in texts).lower()} AS is_text, count(*) AS row_count, count({c}) AS non_null, "
        + sql.pct(f"count(*) FILTER ({c} IS NULL" + (f" OR lower({sql.strip(c)}) IN ({tokens})" if c in texts else "") + ")",
                  "count(*)") + " AS missing_pct, "
        + (f"count(*) FILTER ({sql.strip(c)} <> '') AS non_blank, sum(length({c})) AS total_length, "
           + ", ".join(f"count(*) FILTER ({sql.matches(c, p)})" for p in (rules.EMAIL, rules.PHONE, rules.SSN)).replace("), count", ") + count")
           if c in texts else "0 AS non_blank, NULL AS total_length, 0") + f" AS pii FROM {view}" for c in columns)
    textual = f"(is_text AND NOT {sql.any_token(name, rules.NON_TEXT_NAME_TOKENS)})"
    over = lambda part: (f"CASE WHEN count(*) FILTER ({textual}) > 0 THEN count(*) FILTER ({textual} AND non_null > 0 AND {part})"
                         f"::DOUBLE / count(*) FILTER ({textual}) ELSE 0 END")
    flag = lambda cond: f"max(CASE WHEN {cond} THEN 1 ELSE 0 END)"
    leak = f"sum(CASE WHEN {sql.any_token(name, rules.PII_NAME_TOKENS)} THEN row_count ELSE pii END)::DOUBLE / (max(row_count) * count(*))"
    return f"""col_metrics AS ({parts}),
data_metrics AS (SELECT '{dataset}' AS dataset_id,
  ({flag("column_name LIKE '%\\_id' ESCAPE '\\' OR contains(column_name, 'member_id') OR contains(column_name, 'patient_id')")}
   + {flag(sql.any_token(name, ('date', 'dob')))} + {flag(sql.any_token(name, rules.CODE_NAME_TOKENS))})::DOUBLE / 3 AS key_fields_presence,
  {over('non_blank::DOUBLE / non_null >= 0.7')} AS text_density,
  {over('total_length::DOUBLE / non_null BETWEEN 40 AND 500 AND non_blank::DOUBLE / non_null >= 0.5')} AS chunkable_text_quality,
  1 - avg(missing_pct) / 100 AS missingness_health,
  (SELECT count(*) FROM (SELECT DISTINCT {', '.join(columns)} FROM {view}))::DOUBLE / max(row_count) AS dedup_health,
  1 - ({invalid_total})::DOUBLE / (max(row_count) * {tracked}) AS normalization_health,
  greatest(0, least(1, 1 - ({leak}) * CAST(1.4 AS DOUBLE))) AS pii_safety,
  count(*) FILTER (regexp_matches(column_name, '^[a-z0-9_]+$'))::DOUBLE / count(*) AS schema_clarity FROM col_metrics),
{checks_sql(rules.DATA_CHECKS, 'after', 'data_metrics')}"""


_AFTER = after_ctes("cleaned", CLAIMS_COLUMNS, [c for c in CLAIMS_COLUMNS if c != "accepted_flag"],
                    f"SELECT sum(invalid) FROM ({_INVALID_ROWS})", len(CLAIMS_COLUMNS), "claims")


def claims_checks(spark, sf):
    plan = claims_plan(spark, sf)
    # Cleaned and deduplicated once; what follows measures the written rows.
    cleaned = materialize(plan.clean(claims(spark, sf)), "claims")
    return materialize(readiness.data_checks(
        qc.column_metrics(cleaned, dataset="claims"), duplicates_left(plan, cleaned, dataset="claims"),
        invalid_totals(plan.conversion(spark))), "checks")


@query("readiness_data", f"{_CLEANED}, {_AFTER} SELECT check_id, status, metric FROM after_checks")
def _(spark, sf):
    return claims_checks(spark, sf).select("check_id", "status", "metric")


@query("readiness_data_score", f"{_CLEANED}, {_AFTER} SELECT *, {BAND} AS readiness_band FROM after_score")
def _(spark, sf):
    return readiness.readiness_score(claims_checks(spark, sf)).drop("summary")


@query("top_blockers", f"""{_CLEANED}, {_AFTER} SELECT blocker_rank, check_id, status, metric, recommendation FROM (SELECT *,
 row_number() OVER (ORDER BY CASE status WHEN 'fail' THEN 0 ELSE 1 END, metric, check_order) AS blocker_rank
 FROM after_checks WHERE status IN ('fail', 'warn')) WHERE blocker_rank <= 5""")
def _(spark, sf):
    return readiness.top_blockers(claims_checks(spark, sf)).drop(DATASET, "label")


_BOTH = (f"WITH claims AS (SELECT 'claims' AS dataset_id, * FROM ({sql.CLAIMS})), "
         f"{profile_ctes('claims', CLAIMS_COLUMNS)}, {BEFORE}, cleaned AS ({CLEAN_CLAIMS_SQL}), {_AFTER}")
_RANK = "CASE {} WHEN 'pass' THEN 2 WHEN 'warn' THEN 1 ELSE 0 END"
_COMPARED = f"""compared AS (SELECT check_id, a.check_order, a.label, b.status AS status_before, a.status AS status_after,
  CASE WHEN {_RANK.format('a.status')} > {_RANK.format('b.status')} THEN 'improved'
   WHEN {_RANK.format('a.status')} < {_RANK.format('b.status')} THEN 'regressed' ELSE 'unchanged' END AS status_delta,
  b.metric AS metric_before, a.metric AS metric_after, round_even(a.metric - b.metric, 3) AS metric_delta,
  a.recommendation AS recommended_action FROM after_checks a FULL JOIN before_checks b USING (dataset_id, check_id)),
prioritized AS (SELECT *, CASE WHEN status_delta = 'regressed' OR status_after = 'fail' THEN 'high'
  WHEN status_after = 'warn' THEN 'medium' ELSE 'low' END AS priority FROM compared)"""


def claims_before(spark, sf):
    return materialize(readiness.profile_checks(profile.profile_columns(
        claims(spark, sf), dataset="claims", order_by="row_id", as_of=AS_OF, exclude=("row_id",))), "profiled")


def claims_compared(spark, sf):
    return readiness.compare_checks(claims_before(spark, sf), claims_checks(spark, sf))


@query("readiness_compare", f"{_BOTH}, {_COMPARED} SELECT * EXCLUDE (check_order) FROM prioritized")
def _(spark, sf):
    return claims_compared(spark, sf).drop(DATASET, "check_order")


@query("priority_actions", f"""{_BOTH}, {_COMPARED} SELECT row_number() OVER (ORDER BY CASE priority WHEN 'high' THEN 0 ELSE 1 END,
 CASE status_delta WHEN 'regressed' THEN 0 ELSE 1 END, {_RANK.format('status_after')}, metric_after, check_order) AS action_rank,
 check_id, priority, CASE WHEN status_delta = 'regressed' THEN 'Worse than before' WHEN status_after = 'fail'
 THEN 'Fails still' ELSE 'Warns still' END AS reason, recommended_action AS action
FROM prioritized WHERE priority IN ('high', 'medium')""")
def _(spark, sf):
    return readiness.priority_actions(claims_compared(spark, sf)).drop(DATASET, "label")


@query("comparison_summary", f"""{_BOTH}, {_COMPARED} SELECT count(*) FILTER (status_delta = 'improved') AS improved,
 count(*) FILTER (status_delta = 'regressed') AS regressed, count(*) FILTER (status_delta = 'unchanged') AS unchanged,
 (SELECT readiness_score FROM before_score) AS score_before, (SELECT readiness_score FROM after_score) AS score_after,
 (SELECT readiness_score FROM after_score) - (SELECT readiness_score FROM before_score) AS score_delta FROM prioritized""")
def _(spark, sf):
    before, after = claims_before(spark, sf), claims_checks(spark, sf)
    return readiness.comparison_summary(
        readiness.compare_checks(before, after), readiness.readiness_score(before), readiness.readiness_score(after)
    ).select("improved", "regressed", "unchanged", "score_before", "score_after", "score_delta")


@query("readiness_delta", f"""{_BOTH} SELECT a.readiness_score, b.readiness_score AS profile_score,
 a.readiness_score - b.readiness_score AS delta_from_profile_score FROM after_score a JOIN before_score b USING (dataset_id)""")
def _(spark, sf):
    return readiness.score_delta(readiness.readiness_score(claims_checks(spark, sf)),
                                 readiness.readiness_score(claims_before(spark, sf))).drop(DATASET)


# --- outcomes ---------------------------------------------------------------
# Every order stands for one run; its figures follow from its keys.
FACTS = """
SELECT CAST(o_custkey AS STRING) AS dataset_id, CAST(o_orderkey AS STRING) AS run_id,
  CAST(o_orderkey % 40 AS DOUBLE) AS missing_raw, CAST(o_orderkey % 40 + o_custkey % 8 AS DOUBLE) AS missing_cleaned,
  o_orderkey % 97 AS invalid_total, 1 + o_orderkey % 6 AS tracked_columns, 400 + o_orderkey % 900 AS row_count_cleaned,
  o_orderkey % 3 AS duplicate_rows_removed, (o_orderkey % 5) % 3 AS high_issues,
  CASE o_orderstatus WHEN 'F' THEN 'pass' WHEN 'O' THEN 'warn' WHEN 'P' THEN 'fail' END AS pii_status,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(40 + o_orderkey % 60 AS INT) END AS score_before,
  CAST(40 + o_custkey % 61 AS INT) AS score_after, CAST(floor(o_totalprice) AS BIGINT) AS duration_ms
FROM orders"""
KEYS = (DATASET, "run_id")


def order_facts(spark, sf):
    return spark.sql(FACTS.replace("FROM orders", "FROM {orders}"), orders=table(spark, sf, "orders"))


def _outcomes_sql(own_modes: bool = False) -> str:
    delta = "round_even(missing_cleaned - missing_raw, 3)"
    rate = "round_even(invalid_total::DOUBLE / greatest(1, row_count_cleaned * tracked_columns) * 100, 3)"
    goal = "coalesce(score_before, 70)"
    mode = _MODE if own_modes else "'balanced'"
    dedup_on = _DEDUP if own_modes else "true"
    limit = f"CASE {mode} WHEN 'fast' THEN 180000 WHEN 'ultra_fast' THEN 120000 ELSE 300000 END"
    most = lambda v, p, w: f"CASE WHEN {v} <= {p} THEN 'pass' WHEN {v} <= {w} THEN 'warn' ELSE 'fail' END"
    rows = (
        ("missingness_reduction", most(delta, 2, 5), f"CAST({delta} AS VARCHAR)",
         "'avg_missing_raw=' || printf('%.3f', missing_raw) || ', avg_missing_cleaned=' || printf('%.3f', missing_cleaned)"),
        ("invalid_value_reduction", most(rate, 1, 3), f"CAST({rate} AS VARCHAR)",
         "'invalid_total=' || invalid_total || ', cleaned_rows=' || row_count_cleaned || ', invalid_columns_tracked=' || tracked_columns"),
        ("duplicate_reduction", f"CASE WHEN {dedup_on} AND duplicate_rows_removed > 0 THEN 'pass' ELSE 'warn' END",
         "CAST(duplicate_rows_removed AS VARCHAR)", "'duplicate_rows_removed=' || duplicate_rows_removed || ', dedup_enabled=' || "
         f"CASE WHEN {dedup_on} THEN 'True' ELSE 'False' END"),
        ("critical_date_integrity", most("high_issues", 0, 1), "CAST(high_issues AS VARCHAR)", "'high_severity_issues=' || high_issues"),
        ("pii_safety", "coalesce(pii_status, 'warn')", "coalesce(pii_status, 'unknown')", "'status of the readiness check'"),
        ("rag_readiness_score", f"CASE WHEN score_after >= {goal} THEN 'pass' WHEN score_after >= greatest(60, {goal} - 10) "
         "THEN 'warn' ELSE 'fail' END", "CAST(score_after AS VARCHAR)",
         "'rag_before=' || coalesce(CAST(score_before AS VARCHAR), 'None') || ', rag_after=' || score_after"),
        ("run_duration_target", most("duration_ms", limit, f"1.5 * {limit}"), "CAST(duration_ms AS VARCHAR)",
         f"'duration_ms=' || duration_ms || ', performance_mode=' || {mode}"),
    )
    return "facts AS (" + FACTS + "), outcomes AS (" + " UNION ALL ".join(
        f"SELECT dataset_id, run_id, {i} AS outcome_order, '{o}' AS outcome_id, {sql.quote(rules.OUTCOME_LABELS[o])} AS label, "
        f"{status} AS status, {seen} AS observed_value, {evidence} AS evidence, "
        + (f"CASE WHEN {dedup_on} THEN {sql.quote(rules.OUTCOME_ACTIONS[o])} ELSE "
           f"{sql.quote(rules.OUTCOME_ACTIONS['duplicate_reduction_off'])} END" if o == "duplicate_reduction"
           else sql.quote(rules.OUTCOME_ACTIONS[o])) + " AS recommended_action FROM facts"
        for i, (o, status, seen, evidence) in enumerate(rows)) + ")"


_MODE = "CASE CAST(run_id AS BIGINT) % 3 WHEN 0 THEN 'balanced' WHEN 1 THEN 'fast' ELSE 'ultra_fast' END"
_DEDUP = "CAST(run_id AS BIGINT) % 4 <> 0"
OUTCOMES = "WITH " + _outcomes_sql()
_CRITICAL = f"status = 'fail' AND outcome_id IN ({sql.quoted(rules.CRITICAL_OUTCOMES)})"
GATE = f"""gate AS (SELECT dataset_id, run_id, count(*) FILTER (status = 'pass') AS passed,
  count(*) FILTER (status = 'warn') AS warned, count(*) FILTER (status = 'fail') AS failed,
  coalesce(string_agg(outcome_id, ',' ORDER BY outcome_order) FILTER (status = 'fail'), '') AS failed_outcomes,
  CASE WHEN count(*) FILTER (status = 'fail') = 0 THEN 'pass' WHEN count(*) FILTER ({_CRITICAL}) > 0 THEN 'fail'
   ELSE 'warn' END AS gate_status FROM outcomes GROUP BY dataset_id, run_id)"""


def order_outcomes(spark, sf):
    return outcomes.evaluate(order_facts(spark, sf), keys=KEYS)


@query("outcomes", f"{OUTCOMES} SELECT * EXCLUDE (label) FROM outcomes")
def _(spark, sf):
    return order_outcomes(spark, sf).drop("label", "target", "unit")


@query("outcomes_by_mode", f"WITH {_outcomes_sql(True)} SELECT * EXCLUDE (label) FROM outcomes")
def _(spark, sf):
    facts = order_facts(spark, sf).selectExpr("*", f"{_MODE} AS performance_mode", f"{_DEDUP} AS dedup_enabled")
    return outcomes.evaluate(facts, keys=KEYS).drop("label", "target", "unit")


@query("quality_gate", f"{OUTCOMES}, {GATE} SELECT * FROM gate")
def _(spark, sf):
    return outcomes.quality_gate(order_outcomes(spark, sf), KEYS).withColumn(
        "failed_outcomes", F.array_join("failed_outcomes", ",")).drop("summary")


_RELEASE = " ".join(f"WHEN '{k}' THEN {sql.quote(v)}" for k, v in rules.RELEASE_TEXTS.items())


@query("release_decision", f"""{OUTCOMES}, {GATE}, acts AS (SELECT dataset_id, run_id, recommended_action,
  min(CASE status WHEN 'fail' THEN 0 ELSE 100 END + outcome_order) AS o FROM outcomes WHERE status <> 'pass' GROUP BY ALL),
actions AS (SELECT dataset_id, run_id, string_agg(recommended_action, ' | ' ORDER BY o) AS actions FROM acts GROUP BY ALL),
blockers AS (SELECT dataset_id, run_id, string_agg(label || ': ' || evidence, ' | ' ORDER BY outcome_order)
  FILTER ({_CRITICAL}) AS blockers FROM outcomes GROUP BY ALL)
SELECT dataset_id, run_id, gate_status AS status, coalesce(blockers, '') AS blockers,
 coalesce(actions, {sql.quote(rules.NO_ACTIONS)}) AS actions, CASE gate_status {_RELEASE} END AS release_recommendation
FROM gate LEFT JOIN actions USING (dataset_id, run_id) LEFT JOIN blockers USING (dataset_id, run_id)""")
def _(spark, sf):
    decided = outcomes.release_decision(order_outcomes(spark, sf), KEYS)
    return decided.withColumns({c: F.array_join(c, " | ") for c in ("blockers", "actions")})


# --- whole runs -------------------------------------------------------------
def claims_run(spark, sf):
    return clean_run(claims(spark, sf), dataset="claims", options=CleanOptions(as_of=AS_OF), hints=CLAIMS_HINTS,
                     exclude=("row_id",))


@query("clean_run_table", f"{C} {CLEAN_CLAIMS_SQL}")
def _(spark, sf):
    return claims_run(spark, sf).table


@query("clean_run_score", f"{_CLEANED}, {_AFTER} SELECT *, {BAND} AS readiness_band FROM after_score")
def _(spark, sf):
    return claims_run(spark, sf).score.drop("summary")


@query("clean_run_columns", f"{_CLEANED}, {_QC} SELECT * FROM qc")
def _(spark, sf):
    return claims_run(spark, sf).columns.drop(DATASET)


@query("clean_run_issues", f"""{_CLEANED}, {_severity(_counted('cleaned', _CLEAN_RULES, dataset="'claims'"))}
SELECT issue_type, column_name, count, row_count, severity, rate_pct FROM issues""")
def _(spark, sf):
    return claims_run(spark, sf).issues.select("issue_type", COLUMN, "count", "row_count", "severity", "rate_pct")


_RUN_FACTS = f"""{_CLEANED}, {_QC}, {_AFTER}, {_severity(_counted('cleaned', _CLEAN_RULES, dataset="'claims'"))},
f AS (SELECT avg(missing_pct_cleaned) - avg(missing_pct_raw) AS worse, sum(invalid) AS invalid,
  (SELECT count(*) FROM cleaned) AS kept, (SELECT count(*) FROM claims) - (SELECT count(*) FROM cleaned) AS removed,
  (SELECT count(*) FROM issues WHERE severity = 'high') AS high, (SELECT readiness_score FROM after_score) AS score,
  (SELECT status FROM after_checks WHERE check_id = 'pii_safety') AS pii FROM qc)"""
_AT_MOST = "CASE WHEN {0} <= {1} THEN 'pass' WHEN {0} <= {2} THEN 'warn' ELSE 'fail' END"
_RUN_STATUS = {
    "missingness_reduction": _AT_MOST.format("round_even(worse, 3)", 2, 5),
    "invalid_value_reduction": _AT_MOST.format(
        f"round_even(invalid::DOUBLE / greatest(1, kept * {len(CLAIMS_COLUMNS)}) * 100, 3)", 1, 3),
    "duplicate_reduction": "CASE WHEN removed > 0 THEN 'pass' ELSE 'warn' END",
    "critical_date_integrity": _AT_MOST.format("high", 0, 1), "pii_safety": "pii",
    "rag_readiness_score": "CASE WHEN score >= 70 THEN 'pass' WHEN score >= 60 THEN 'warn' ELSE 'fail' END",
}
_RUN_ROWS = " UNION ALL ".join(f"SELECT '{k}' AS outcome_id, {v} AS status FROM f" for k, v in _RUN_STATUS.items())


@query("clean_run_outcomes", f"{_RUN_FACTS} {_RUN_ROWS}")
def _(spark, sf):
    # The time of the run is its own; the other six follow from the data.
    return claims_run(spark, sf).outcomes.select("outcome_id", "status").where("outcome_id <> 'run_duration_target'")


_RUN_GATE = f"""{_RUN_FACTS}, o AS ({_RUN_ROWS}) SELECT CASE WHEN count(*) FILTER (status = 'fail') = 0 THEN 'pass'
 WHEN count(*) FILTER ({_CRITICAL}) > 0 THEN 'fail' ELSE 'warn' END AS gate_status,
 count(*) FILTER (status = 'fail') AS failed FROM o"""


@query("clean_run_gate", _RUN_GATE)
def _(spark, sf):
    rows = claims_run(spark, sf).outcomes.where("outcome_id <> 'run_duration_target'")
    return outcomes.quality_gate(rows).select("gate_status", "failed")


@query("precheck_run", f"""{_BOTH} SELECT readiness_score, {BAND} AS readiness_band FROM before_score""")
def _(spark, sf):
    found = precheck(claims(spark, sf), dataset="claims", order_by="row_id", options=CleanOptions(as_of=AS_OF),
                     exclude=("row_id",))
    return found.datasets.select("readiness_score", "readiness_band")
