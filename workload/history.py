"""Retrieval text, autopilot and run history."""

from __future__ import annotations

from pyspark.sql import functions as F

from claritable import rules
from claritable.operators import assess, ledger, outcomes, profile, qc, readiness, retrieval
from claritable.operators.cells import COLUMN, DATASET
from claritable.plans.autopilot import autopilot, autopilot_options
from claritable.sources.scratch import new_path
from workload import sql
from workload.cleaning import CLEAN_MESSY_SQL, MESSY_HINTS, clean_messy
from workload.inputs import AS_OF, MESSY_COLUMNS, messy, segment_messy, table
from workload.profiles import BAND, BEFORE, PROF, _domains, segment_profile
from workload.registry import query
from workload.scores import GATE, KEYS, OUTCOMES, order_facts, order_outcomes

M = sql.WITH_MESSY
_KEPT = tuple(c for c in MESSY_COLUMNS if c != "empty_col")
_CLEANED = f"{M}, cleaned AS ({CLEAN_MESSY_SQL})"


# --- text columns -----------------------------------------------------------
def _text_stats(view: str, columns) -> str:
    tokens = sql.quoted(rules.MISSING_TOKENS)
    return " UNION ALL ".join(
        f"SELECT dataset_id, {i} AS position, '{c}' AS column_name, "
        f"CASE WHEN count({c}) > 0 THEN count(*) FILTER ({sql.strip(c)} <> '')::DOUBLE / count({c}) ELSE 0 END AS non_empty_ratio, "
        f"CASE WHEN count({c}) > 0 THEN sum(length({c}))::DOUBLE / count({c}) ELSE 0 END AS avg_len, "
        + sql.pct(f"count(*) FILTER ({c} IS NULL OR lower({sql.strip(c)}) IN ({tokens}))", "count(*)")
        + f" AS missing_pct FROM {view} GROUP BY dataset_id" for i, c in enumerate(columns))


_OPEN = f"NOT {sql.any_token('column_name', rules.NON_TEXT_NAME_TOKENS)}"
_FREE = f"NOT {sql.any_token('column_name', rules.PROTECTED_NAME_TOKENS)}"
_STATS = f"{sql.WITH_SEGMENTS}, stats AS ({_text_stats('messy', MESSY_COLUMNS)})"


def segment_metrics(spark, sf):
    return qc.column_metrics(segment_messy(spark, sf), dataset=F.col(DATASET), exclude=("row_id", DATASET))


@query("text_candidates", f"""{_STATS} SELECT dataset_id, column_name, non_empty_ratio, avg_len,
 non_empty_ratio >= 0.5 AND avg_len BETWEEN 40 AND 500 AS chunkable FROM stats WHERE {_OPEN}""")
def _(spark, sf):
    return retrieval.text_candidates(segment_metrics(spark, sf)).withColumn(
        "chunkable", retrieval.is_chunkable()).drop("position")


@query("drop_low_signal", f"""{_STATS}, weak AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY position) AS drop_rank
 FROM stats WHERE {_OPEN} AND {_FREE} AND (non_empty_ratio < 0.35 OR avg_len < 8))
SELECT dataset_id, column_name, drop_rank FROM weak WHERE drop_rank <= greatest(1, floor({len(MESSY_COLUMNS)} * CAST(0.2 AS DOUBLE)))""")
def _(spark, sf):
    return retrieval.low_signal_columns(segment_metrics(spark, sf)).select(DATASET, COLUMN, "drop_rank")


@query("drop_high_missing", f"""{_STATS}, sparse AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY position) AS drop_rank
 FROM stats WHERE {_FREE} AND missing_pct >= 92)
SELECT dataset_id, column_name, missing_pct, drop_rank FROM sparse
WHERE drop_rank <= greatest(1, floor({len(MESSY_COLUMNS)} * CAST(0.15 AS DOUBLE)))""")
def _(spark, sf):
    return retrieval.high_missing_columns(segment_metrics(spark, sf)).drop("position")


_PII_NAMED = [c for c in _KEPT if any(t in c for t in rules.PII_COLUMN_TOKENS)]


@query("drop_pii_named", f"{_CLEANED} SELECT row_id, patient_id, paid_amount, icd_code, notes FROM cleaned")
def _(spark, sf):
    cleaned = clean_messy(spark, sf)
    kept = cleaned.drop(*retrieval.pii_named_columns(cleaned.columns))
    return kept.select("row_id", "patient_id", "paid_amount", "icd_code", "notes")


# --- context and projection -------------------------------------------------
_CANDIDATES = [c for c in _KEPT if c not in _PII_NAMED]
_TYPED = ("visit_date",)


def _sized(pairs: str, fallback: str, suffix: str) -> str:
    filled = f"CASE WHEN {pairs} = '' THEN {fallback} ELSE {pairs} END"
    return f"CASE WHEN length({filled}) < 40 THEN {filled} || {sql.quote(suffix)} ELSE {filled} END"


def _chunks(rows: str, keys: str) -> str:
    """All text of ``rows``, 480 characters to a row."""
    return (f"SELECT {keys}, chunk::INTEGER AS chunk, substr(rag_context, chunk * 480 + 1, 480) AS rag_context FROM ("
            f"SELECT *, unnest(range(greatest(1, CAST(ceil(length(rag_context) / 480.0) AS INTEGER)))) AS chunk FROM ({rows}))")


def _pairs(columns, value) -> str:
    tokens = sql.quoted(rules.MISSING_TOKENS)
    return "concat_ws('; ', " + ", ".join(
        f"CASE WHEN lower({value(c)}) NOT IN ({tokens}) THEN '{c}=' || {value(c)} END" for c in columns) + ")"


# Column choice: text and narrative names first, then variety, then position.
_NARRATIVE = [c for c in _CANDIDATES if any(t in c for t in rules.NARRATIVE_TOKENS)]
_VARIETY = " UNION ALL ".join(
    f"SELECT '{c}' AS c, {_KEPT.index(c)} AS pos, count(DISTINCT {c}) AS n, "
    f"{(0 if c in _TYPED else 3) + (3 if c in _NARRATIVE else 0)} AS s FROM cleaned" for c in _CANDIDATES)
_LONG = " UNION ALL ".join(f"SELECT row_id, '{c}' AS c, CAST({c} AS VARCHAR) AS v FROM cleaned" for c in _CANDIDATES)


_CONTEXT = f"""{_CLEANED}, chosen AS (SELECT c, row_number() OVER (ORDER BY s DESC, n DESC, pos) AS k FROM ({_VARIETY}) WHERE n > 0),
cells AS (SELECT row_id, c, k, {sql.strip('v')} AS v FROM ({_LONG}) JOIN chosen USING (c)),
pairs AS (SELECT row_id, coalesce(string_agg(c || '=' || v, '; ' ORDER BY k) FILTER (lower(v) NOT IN ({sql.quoted(rules.MISSING_TOKENS)})), '') AS p
 FROM cells GROUP BY row_id)
"""
_CONTEXT_ROWS = f"SELECT row_id, {_sized('p', chr(39) + 'row=' + chr(39) + ' || row_id', rules.CONTEXT_SUFFIX)} AS rag_context FROM pairs"


@query("rag_context", _CONTEXT + _chunks(_CONTEXT_ROWS, "row_id"))
def rag_context(spark, sf):
    return retrieval.chunked(retrieval.with_context(clean_messy(spark, sf), "row_id").select("row_id", "rag_context"))


_PROJECTED = [c for c in _KEPT if c not in _PII_NAMED]
_PROJECTION = f"""{_CLEANED}, p AS (SELECT *, {_pairs(_PROJECTED, lambda c: sql.collapse(sql.redact(sql.strip(c))))} AS pairs FROM cleaned)
"""
_PROJECTION_ROWS = f"""SELECT patient_id AS record_id, coalesce({sql.date_text('dob')}, '{AS_OF.isoformat()}') AS event_date,
 upper(coalesce(nullif({sql.strip('icd_code')}, ''), 'general')) AS domain_code,
 {_sized('pairs', f"'record_id=' || patient_id || '; {rules.PROJECTION_FALLBACK}'", rules.PROJECTION_SUFFIX)} AS rag_context FROM p"""


@query("rag_projection", _PROJECTION + _chunks(_PROJECTION_ROWS, "record_id, event_date, domain_code"))
def rag_projection(spark, sf):
    return retrieval.chunked(retrieval.retrieval_projection(clean_messy(spark, sf), "row_id", AS_OF))


_ORDER_TEXT = f"""WITH p AS (SELECT *, {_pairs(('order_id', 'status', 'priority'), lambda c: sql.collapse(sql.redact(sql.strip(c))))} AS pairs FROM (
 SELECT o_orderkey AS row_id, CAST(o_orderkey AS VARCHAR) AS order_id, o_orderstatus AS status, o_orderpriority AS priority FROM orders))"""


@query("rag_projection_orders", f"""{_ORDER_TEXT} SELECT order_id AS record_id, '{AS_OF.isoformat()}' AS event_date,
 'GENERAL' AS domain_code, {_sized('pairs', "'record_id=' || order_id", rules.PROJECTION_SUFFIX)} AS rag_context FROM p""")
def _(spark, sf):
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("row_id"), F.col("o_orderkey").cast("string").alias("order_id"),
        F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    return retrieval.retrieval_projection(orders, "row_id", AS_OF)


def _autopilot(spark, sf):
    return autopilot(messy(spark, sf), "row_id", autopilot_options("training", as_of=AS_OF),
                     target_score=95, dataset="messy", hints=MESSY_HINTS)


@query("autopilot")
def _(spark, sf):
    return _autopilot(spark, sf)[1].table


@query("autopilot_summary")
def _(spark, sf):
    result = _autopilot(spark, sf)[1]
    blockers = readiness.top_blockers(result.checks).groupBy(DATASET).agg(
        F.array_join(F.sort_array(F.collect_list("check_id")), ",").alias("post_blockers"))
    return result.report(spark, "messy").withColumn("actions", F.array_join("actions", " | ")).join(
        blockers, DATASET, "left")


# --- run history ------------------------------------------------------------
# Every order is a run: it starts on its date and, unless open, ends the next day.
EVENTS = """
SELECT CAST(o_custkey AS STRING) AS dataset_id, CAST(o_orderkey AS STRING) AS run_id,
  CAST(o_orderdate AS TIMESTAMP) AS event_time, 'running' AS status,
  CASE o_orderkey % 3 WHEN 0 THEN 'balanced' WHEN 1 THEN 'fast' ELSE 'ultra_fast' END AS performance_mode,
  CASE WHEN o_orderkey % 2 = 0 THEN 'deterministic' END AS cleanup_mode, CAST(NULL AS BIGINT) AS duration_ms,
  CAST(NULL AS STRING) AS error
FROM orders
UNION ALL
SELECT CAST(o_custkey AS STRING), CAST(o_orderkey AS STRING), CAST(o_orderdate AS TIMESTAMP) + INTERVAL 1 DAY,
  CASE o_orderstatus WHEN 'F' THEN 'completed' ELSE CASE WHEN o_orderkey % 4 = 0 THEN 'cancelled' ELSE 'failed' END END,
  NULL, NULL, CAST(floor(o_totalprice) AS BIGINT), CASE o_orderstatus WHEN 'F' THEN NULL ELSE 'stopped' END
FROM orders WHERE o_orderstatus <> 'O'"""
STATE = f"""WITH events AS ({EVENTS}), runs AS (SELECT run_id, min(event_time) AS created_at, max(event_time) AS updated_at,
  arg_max(dataset_id, event_time) AS dataset_id, arg_max(status, event_time) AS status,
  max(performance_mode) AS performance_mode, max(cleanup_mode) AS cleanup_mode, max(duration_ms) AS duration_ms,
  max(error) AS error FROM events GROUP BY run_id)"""
_DAY = "strftime({}, '%Y-%m-%d') AS {}"


def order_events(spark, sf):
    return spark.sql(EVENTS.replace("FROM orders", "FROM {orders}"), orders=table(spark, sf, "orders"))


def order_runs(spark, sf):
    return ledger.current_runs(order_events(spark, sf))


def _day(name):
    return F.date_format(name, "yyyy-MM-dd").alias(name)


@query("runs_state", f"""{STATE} SELECT run_id, dataset_id, status, performance_mode, cleanup_mode, duration_ms, error,
 {_DAY.format('created_at', 'created_at')}, {_DAY.format('updated_at', 'updated_at')} FROM runs""")
def _(spark, sf):
    return order_runs(spark, sf).select("run_id", DATASET, "status", "performance_mode", "cleanup_mode",
                                        "duration_ms", "error", _day("created_at"), _day("updated_at"))


@query("ledger_append", f"""{STATE} SELECT run_id, dataset_id, status, duration_ms, {_DAY.format('created_at', 'created_at')} FROM runs""")
def _(spark, sf):
    book = ledger.RunLedger(spark, new_path(spark, "ledger"))
    events = order_events(spark, sf)
    book.append(events.filter(F.col("status") == "running"))
    book.append(events.filter(F.col("status") != "running"))
    return book.runs().select("run_id", DATASET, "status", "duration_ms", _day("created_at"))


@query("runs_list", f"""{STATE}, placed AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY created_at DESC, run_id DESC) AS place FROM runs)
SELECT dataset_id, run_id, status, place FROM placed WHERE place <= 20""")
def _(spark, sf):
    return ledger.list_runs(order_runs(spark, sf), limit=20).select(DATASET, "run_id", "status", "place")


@query("runs_of_dataset", f"""{STATE} SELECT dataset_id, run_id, status FROM runs WHERE dataset_id = '7'
ORDER BY created_at DESC, run_id DESC LIMIT 20""")
def _(spark, sf):
    book = ledger.RunLedger(spark, new_path(spark, "ledger"))
    book.append(order_events(spark, sf))
    return ledger.list_runs(book.runs("7"), "7", limit=20).select(DATASET, "run_id", "status")


@query("runs_latest", f"""{STATE} SELECT dataset_id, run_id, status, duration_ms FROM (SELECT *, row_number() OVER (
 PARTITION BY dataset_id ORDER BY created_at DESC, run_id DESC) AS k FROM runs) WHERE k = 1""")
def runs_latest(spark, sf):
    return ledger.latest_run(order_runs(spark, sf)).select(DATASET, "run_id", "status", "duration_ms")


# Datasets are customers; the flags follow from the key.
_DATASETS = """SELECT CAST(c_custkey AS STRING) AS dataset_id, c_mktsegment AS domain,
  CAST('2024-01-01' AS TIMESTAMP) + INTERVAL 1 DAY * (c_custkey % 700) AS created_at,
  CASE c_custkey % 7 WHEN 0 THEN 'processing' WHEN 1 THEN 'error' WHEN 2 THEN 'Running' ELSE 'cleaned' END AS status,
  c_custkey % 3 <> 0 AS has_profile, c_custkey % 2 = 0 AS has_cleaned, c_custkey % 5 <> 0 AS has_qc,
  CASE WHEN c_custkey % 4 = 0 THEN 'assisted' END AS cleanup_mode FROM customer"""


def _datasets(spark, sf):
    return spark.sql(_DATASETS.replace("FROM customer", "FROM {c}").replace(
        "INTERVAL 1 DAY * (c_custkey % 700)", "make_dt_interval(CAST(c_custkey % 700 AS INT))"),
        c=table(spark, sf, "customer"))


@query("datasets_list", f"WITH d AS ({_DATASETS}) SELECT dataset_id, {_DAY.format('created_at', 'created_at')} FROM d ORDER BY d.created_at DESC, dataset_id DESC LIMIT 25")
def _(spark, sf):
    return ledger.list_datasets(_datasets(spark, sf), 25).select(DATASET, _day("created_at"))


_STAGE = """CASE WHEN lower(status) IN ('running', 'processing') THEN 'running' WHEN lower(status) IN ('failed', 'error') THEN 'failed'
 WHEN has_cleaned AND has_qc THEN 'completed' WHEN has_profile THEN 'prechecked' ELSE 'uploaded' END"""
_NEXT = " ".join(f"WHEN '{k}' THEN '{','.join(v)}'" for k, v in rules.STAGE_ACTIONS.items())


@query("workflow_stage", f"WITH d AS ({_DATASETS}), s AS (SELECT dataset_id, {_STAGE} AS stage FROM d) "
       f"SELECT dataset_id, stage, CASE stage {_NEXT} END AS next_actions FROM s")
def _(spark, sf):
    stage = ledger.workflow_stage(F.col("status"), F.col("has_profile"), F.col("has_cleaned"), F.col("has_qc"))
    return _datasets(spark, sf).select(DATASET, stage.alias("stage")).withColumn(
        "next_actions", F.array_join(ledger.next_actions(F.col("stage")), ","))


@query("execution_summary", f"""{STATE}, d AS ({_DATASETS}), latest AS (SELECT * FROM (SELECT *, row_number() OVER (
  PARTITION BY dataset_id ORDER BY created_at DESC, run_id DESC) AS k FROM runs) WHERE k = 1)
SELECT dataset_id, run_id AS latest_run_id, coalesce(latest.cleanup_mode, d.cleanup_mode, 'deterministic') AS cleanup_mode,
 coalesce(performance_mode, 'balanced') AS performance_mode, coalesce(latest.status, d.status) AS status
FROM d LEFT JOIN latest USING (dataset_id)""")
def _(spark, sf):
    return ledger.execution_summary(_datasets(spark, sf), order_runs(spark, sf))


@query("run_outcomes", f"""{OUTCOMES}, {GATE} SELECT dataset_id, run_id, gate_status, outcome_order, outcome_id, status, evidence
FROM outcomes JOIN gate USING (dataset_id, run_id)""")
def _(spark, sf):
    rows = order_outcomes(spark, sf)
    folded = ledger.outcomes_array(rows, KEYS)
    gates = outcomes.quality_gate(rows, KEYS).select(*KEYS, "gate_status")
    runs = folded.join(gates, list(KEYS)).withColumn("status", F.lit("completed"))
    return ledger.run_outcomes(runs).select(*KEYS, "gate_status", "outcome_order", "outcome_id", "status", "evidence")


@query("result_summary", f"""{OUTCOMES}, {GATE} SELECT dataset_id, run_id, gate_status AS decision_status, gate_status AS quality_gate_status,
 score_after AS rag_score, score_after - score_before AS rag_score_delta FROM gate JOIN facts USING (dataset_id, run_id)""")
def _(spark, sf):
    decided = outcomes.release_decision(order_outcomes(spark, sf), KEYS)
    runs = decided.join(order_facts(spark, sf), list(KEYS)).select(
        F.concat_ws("/", *KEYS).alias(DATASET), F.col("status").alias("decision"), "release_recommendation",
        F.col("status").alias("gate_status"), F.col("score_after").alias("readiness_score"),
        (F.col("score_after") - F.col("score_before")).alias("score_delta"))
    parts = F.split(DATASET, "/")
    return ledger.result_summary(runs).select(
        parts[0].alias(DATASET), parts[1].alias("run_id"), "decision_status", "quality_gate_status", "rag_score",
        "rag_score_delta")


@query("precheck_summary", f"""{PROF}, {BEFORE}, filled AS (SELECT * FROM prof), {_domains('filled')}
SELECT dataset_id, readiness_score, {BAND} AS readiness_band, d.domain AS primary_domain, false AS is_sampled
FROM before_score LEFT JOIN (SELECT * FROM domains WHERE domain_rank = 1) d USING (dataset_id)""")
def _(spark, sf):
    prof = segment_profile(spark, sf)
    scores = readiness.readiness_score(readiness.profile_checks(prof)).select(DATASET, "readiness_score", "readiness_band")
    primary = profile.detect_domains(prof).filter(F.col("domain_rank") == 1).select(
        DATASET, F.col("domain").alias("primary_domain"))
    counts = assess.assessment(assess.column_counts(prof))
    decided = assess.preclean_decision(counts.join(scores, DATASET)).join(primary, DATASET, "left")
    return ledger.precheck_summary(decided.withColumn("sampled", F.lit(False))).select(
        DATASET, "readiness_score", "readiness_band", "primary_domain", "is_sampled")
