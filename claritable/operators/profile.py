"""Column profile: one value histogram, everything else read from it.

The histogram ``(dataset_id, column_name, value) -> n, first_row`` is the only large
shuffle.  Counts are combined before it, so a value that fills a third of a table
travels once per map task.  A value of up to ``KEY_BYTES`` bytes is its own key, and
patterns and parsers run per distinct value.  A longer one travels as a digest of 128
bits with what patterns and parsers found in it, so no row of the shuffle is longer
than a stated size however long the cells are.  Top values and examples are cut per
partition before they are brought together (``row_number() <= k``), so no task ever
holds all values of a column; only the texts of these winners are looked up again.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claritable import rules
from claritable.functions import coerce, names, pii, text
from claritable.functions.scoring import percent, ratio
from claritable.operators.cells import (
    COLUMN,
    DATASET,
    ROW,
    VALUE,
    as_text,
    cells,
    keys_of,
    label_map,
    with_dataset,
)
from claritable.sources.scratch import materialize

EXAMPLES = 5
EXAMPLE_WINDOW = 50
TOP_VALUES = 3
#: Longer values are counted by digest.
KEY_BYTES = 32
DIGEST = "digest"


def _digest(value: Column) -> Column:
    return F.unhex(F.md5(value.cast("binary")))


def _signals(value: Column) -> dict[str, Column]:
    return {
        "number_count": coerce.looks_numeric(value),
        "boolean_count": coerce.looks_boolean(value),
        "pii_email": pii.has_email(value),
        "pii_phone": pii.has_phone(value),
        "pii_ssn": pii.has_ssn(value),
        "zip_count": pii.is_zip(value),
    }


_NUMERIC_SIGNALS = ("number_count", "zip_count")


def histogram(long: DataFrame, keys: list[str], as_of: dt.date) -> DataFrame:
    """Occurrences and first row of every value; missing tokens share the entry without a value.

    ``value`` holds short values. Of a long one there is its digest, its time, its number and its signals as bits;
    these follow from the value, so grouping by them splits no group.
    """
    value = F.col(VALUE)
    is_long = F.octet_length(value) > KEY_BYTES
    # Long cells are parsed one by one, so cheap tests go before the parsers that take most of the time.
    numeric = coerce.may_be_number(value)
    flags = _signals(value) | {k: numeric & v for k, v in _signals(value).items() if k in _NUMERIC_SIGNALS}
    bits = [F.when(flag, F.lit(1 << i)).otherwise(F.lit(0)) for i, flag in enumerate(flags.values())]
    return (
        long.select(*keys, text.normalize_missing(value).alias(VALUE), ROW)
        .select(*keys, F.when(~is_long, value).alias(VALUE),
                F.when(is_long, _digest(value)).alias(DIGEST),
                F.when(is_long & coerce.may_be_date(value), coerce.timestamp(value, as_of)).alias("long_ts"),
                F.when(is_long & numeric, coerce.plain_number(value)).alias("long_num"),
                F.when(is_long, sum(bits[1:], bits[0])).alias("long_bits"), ROW)
        .groupBy(*keys, VALUE, DIGEST, "long_ts", "long_num", "long_bits")
        .agg(F.count(F.lit(1)).alias("n"), F.min(ROW).alias("first_row"))
    )


def _filled() -> Column:
    return F.col(VALUE).isNotNull() | F.col(DIGEST).isNotNull()


def _weighted(flag: Column) -> Column:
    return F.sum(F.when(flag, F.col("n")).otherwise(F.lit(0)))


def measure(hist: DataFrame, keys: list[str], as_of: dt.date) -> DataFrame:
    """Counts and ranges per column."""
    value, bits = F.col(VALUE), F.col("long_bits")
    signals = {name: F.when(bits.isNotNull(), bits.bitwiseAND(1 << i) != 0).otherwise(flag)
               for i, (name, flag) in enumerate(_signals(value).items())}
    parsed = hist.withColumns({"_ts": F.coalesce(coerce.timestamp(value, as_of), F.col("long_ts")),
                               "_num": F.coalesce(coerce.plain_number(value), F.col("long_num"))})
    return parsed.groupBy(*keys).agg(
        F.sum("n").alias("row_count"),
        _weighted(_filled()).alias("non_null"),
        # first_row is read here too, so that all readers share one histogram exchange.
        F.count_if(F.col("first_row").isNotNull() & _filled()).alias("distinct_count"),
        _weighted(F.col("_ts").isNotNull()).alias("date_count"),
        *[_weighted(flag).alias(name) for name, flag in signals.items()],
        F.min("_num").alias("num_min"),
        F.max("_num").alias("num_max"),
        (F.sum(F.col("_num") * F.col("n")) / _weighted(F.col("_num").isNotNull())).alias("num_mean"),
        F.min(F.col("_ts").cast("date")).alias("date_min"),
        F.max(F.col("_ts").cast("date")).alias("date_max"),
    )


def _first_by(hist: DataFrame, keys: list[str], limit: int, *order) -> DataFrame:
    """The first values of each column in the given order; rows of one row key go by short value, then by digest.

    The entry without a value is ordered last and dropped after the cut: a filter below the histogram would
    give this reader an exchange of its own.
    """
    window = W.partitionBy(*keys).orderBy(~_filled(), *order, VALUE, DIGEST)
    return (
        hist.withColumn("rank", F.row_number().over(window))
        .filter((F.col("rank") <= limit) & _filled())
        .select(*keys, "rank", VALUE, DIGEST, "n")
    )


def top_values(hist: DataFrame, keys: list[str], limit: int = TOP_VALUES) -> DataFrame:
    """Most frequent values per column, ties by first appearance."""
    return _first_by(hist, keys, limit, F.desc("n"), "first_row")


def example_values(hist: DataFrame, keys: list[str], window: int = EXAMPLE_WINDOW) -> DataFrame:
    """First values of each column in row order."""
    return _first_by(hist, keys, window, "first_row", F.desc("n"))


def long_texts(long: DataFrame, keys: list[str], wanted: DataFrame, few: bool) -> DataFrame:
    """``(keys, digest, value)`` of the wanted digests, from a second look at the long cells.

    ``few`` says that ``wanted`` holds one table's columns, so at most ``EXAMPLE_WINDOW + TOP_VALUES`` rows of each:
    it is broadcast, and where nothing long was found the cells are not read again. With many datasets Spark
    chooses the join by size.
    """
    wanted = wanted.filter(F.col(DIGEST).isNotNull()).select(*[F.col(k).alias(f"_{k}") for k in keys],
                                                             F.col(DIGEST).alias("_digest"))
    # Null-safe keys: a plain equality would filter null keys below the histogram, which then had two exchanges.
    matches = F.col(DIGEST) == F.col("_digest")
    for k in keys:
        matches &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    # No digest of a missing token is wanted, so tokens need no look here.
    looked_up = (
        long.select(*keys, VALUE)
        .filter(F.octet_length(VALUE) > KEY_BYTES)
        .withColumn(DIGEST, _digest(F.col(VALUE)))
        .join(F.broadcast(wanted) if few else wanted, matches)
    )
    # A set, since its state is merged by hash where a minimum of texts would sort all of their copies.
    return looked_up.groupBy(*keys, DIGEST).agg(F.collect_set(VALUE)[0].alias(VALUE))


def _assemble(stats: DataFrame, top: DataFrame, examples: DataFrame, texts: DataFrame,
              keys: list[str]) -> DataFrame:
    """One row per column from its measures, top values, examples and their long texts.

    A union and one small aggregate rather than joins: a self-join would give each side
    its own copy of the histogram, a union lets all readers share the same exchange.
    """
    measures = [c for c in stats.columns if c not in keys]
    parts = stats
    for rows, fields, name in ((top, ("rank", VALUE, DIGEST, "n"), "_top"),
                               (examples, ("rank", VALUE, DIGEST), "_example"),
                               (texts, (DIGEST, VALUE), "_text")):
        parts = parts.unionByName(rows.select(*keys, F.struct(*fields).alias(name)), allowMissingColumns=True)
    lists = parts.groupBy(*keys).agg(
        *[F.max(c).alias(c) for c in measures],
        F.array_sort(F.collect_list("_top")).alias("_top"),
        F.array_sort(F.collect_list("_example")).alias("_example"),
        F.map_from_entries(F.collect_list("_text")).alias("_text"),
    )
    whole = lambda x: F.coalesce(x[VALUE], F.element_at("_text", x[DIGEST]))
    shown = F.transform("_example", lambda x: text.collapse(whole(x)))
    return lists.select(
        *keys, *measures,
        F.map_from_entries(F.transform("_top", lambda x: F.struct(whole(x), x["n"]))).alias("top_values"),
        F.slice(F.array_distinct(F.filter(shown, lambda x: x != "")), 1, EXAMPLES).alias("example_values"),
    )


def head_cells(long: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """The first ``rows`` non-missing cells of every column, in row order.

    Rows are dealt to more buckets than ``rows`` by their key. The first filled rows of the buckets are different rows, so
    the cells wanted do not lie behind the ``rows``-th of these; only the few cells up to it are sorted. A column with
    filled rows in fewer buckets has few of them, and keeps all.
    """
    filled = long.withColumn(VALUE, text.normalize_missing(F.col(VALUE))).filter(F.col(VALUE).isNotNull())
    bucket = F.pmod(F.xxhash64(ROW), F.lit(2 * rows)).alias("_bucket")
    firsts = filled.groupBy(*keys, bucket).agg(F.min(ROW).alias("_last"))
    place = F.row_number().over(W.partitionBy(*keys).orderBy("_last"))
    # Written, so that Spark knows how small it is: at most one row for each column.
    last = materialize(firsts.withColumn("_place", place).filter(F.col("_place") == rows).drop("_place", "_bucket"), "lasts")
    same = F.lit(True)
    for k in keys:
        same &= F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}"))
    near = filled.alias("x").join(last.alias("y"), same, "left").select("x.*", "_last").filter(
        F.col("_last").isNull() | (F.col(ROW) <= F.col("_last"))).drop("_last")
    order = W.partitionBy(*keys).orderBy(ROW)
    first = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= rows).drop("rank")
    return materialize(first, "heads")


def primitive_type() -> Column:
    share = lambda name: ratio(F.col(name), F.col("infer_total"))
    return (
        F.when(F.col("infer_total") == 0, F.lit("unknown"))
        .when(share("infer_date") > rules.TYPE_SHARE, F.lit("date"))
        .when(share("infer_number") > rules.TYPE_SHARE, F.lit("number"))
        .when(share("infer_boolean") > rules.TYPE_SHARE, F.lit("boolean"))
        .otherwise(F.lit("string"))
    )


def value_hint() -> Column:
    source = {"email": "infer_email", "phone": "infer_phone", "ssn": "infer_ssn",
              "postal_code": "infer_zip"}
    chain = F
    for hint, share in rules.VALUE_HINTS:
        chain = chain.when(ratio(F.col(source[hint]), F.col("infer_total")) > share, F.lit(hint))
    return chain


_INFER = {"infer_total": "non_null", "infer_date": "date_count", "infer_number": "number_count",
          "infer_boolean": "boolean_count", "infer_email": "pii_email",
          "infer_phone": "pii_phone", "infer_ssn": "pii_ssn", "infer_zip": "zip_count"}


#: Standard deviations of a normal distribution that leave out a share of the cases on both sides together.
_DEVIATIONS = {0.1: 1.645, 0.05: 1.96, 0.01: 2.576, 0.001: 3.291}


def bottom_sample(df: DataFrame, rows: int, key: str | list[str] | None = None) -> DataFrame:
    """The ``rows`` rows whose keys have the smallest MD5 hashes; all columns are the key where none is named.

    The hashes behave like a draw without return, so the sample stands for the whole table whatever its order, and is
    the same however the table is partitioned. Samples merge: the sample of a union is the sample of the union of the
    samples. Each task keeps ``rows`` rows. Rows of one key are in or out together but for those at the border, which
    go by their text.
    """
    keys = [key] if isinstance(key, str) else list(key or df.columns)
    whole = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))
    named = F.concat_ws("\x1f", *[F.coalesce(as_text(df, c), F.lit("\x00")) for c in keys])
    return df.orderBy(F.md5(named.cast("binary")), named, whole).limit(rows)


def sample_error(share: float, sampled: int, total: int, risk: float = 0.05) -> float:
    """How far a share of the table may lie from ``share`` of a sample, but for the given risk.

    By the normal approximation, for a draw without return; never less than the share that one row makes up.
    """
    if sampled >= total:
        return 0.0
    left = (total - sampled) / max(1, total - 1)
    return _DEVIATIONS[risk] * (share * (1 - share) / max(1, sampled) * left) ** 0.5 + 1 / max(1, sampled)


def profile_columns(
    df: DataFrame,
    *,
    dataset: str | Column = "dataset",
    order_by: str | Column | None = None,
    as_of: dt.date,
    exclude: tuple[str, ...] = (),
    sample_rows: int | None = None,
    sample_key: str | list[str] | None = None,
    head_rows: int | None = None,
    match: str = "substring",
) -> DataFrame:
    """One row per dataset and column.

    ``sample_rows`` profiles a sample by the hash of ``sample_key`` (:func:`bottom_sample`); shares of it are those
    of the table within :func:`sample_error`.  ``head_rows`` infers
    types, hints and examples from the first non-missing cells of each column instead
    of from all of them.
    """
    source = [c for c in df.columns if c not in exclude]
    columns = dict(zip(source, names.standardize(source)))
    if sample_rows is not None:
        df = bottom_sample(df, sample_rows, sample_key)

    keys = keys_of(dataset)
    long = cells(df, columns, dataset=dataset, order_by=order_by)
    hist = histogram(long, keys, as_of)
    stats = measure(hist, keys, as_of)

    if head_rows is None:
        stats = stats.withColumns({k: F.col(v) for k, v in _INFER.items()})
        examples = example_values(hist, keys)
    else:
        head = histogram(head_cells(long, keys, head_rows), keys, as_of)
        inferred = measure(head, keys, as_of).select(
            *keys, *[F.col(v).alias(k) for k, v in _INFER.items()])
        stats = stats.join(inferred, keys, "left").na.fill(0, list(_INFER))
        examples = example_values(head, keys)

    top = top_values(hist, keys)
    texts = long_texts(long, keys, top.unionByName(examples), few=isinstance(dataset, str))
    parts = _assemble(stats, top, examples, texts, keys)

    clean = F.col(COLUMN)
    originals = label_map({label: source for source, label in columns.items()})
    positions = label_map({label: i for i, label in enumerate(columns.values())})
    if match == "token":
        by_name = label_map({c: names.hint_for(c, "token") or "" for c in columns.values()})[clean]
        by_name = F.nullif(by_name, F.lit(""))
    else:
        by_name = names.hint_expr(clean)

    typed = parts.select(
        "*", primitive_type().alias("primitive_type"),
        F.coalesce(by_name, value_hint()).alias("semantic_hint"),
        percent(F.col("row_count") - F.col("non_null"), F.col("row_count")).alias("missing_pct"),
        (F.col("pii_email") + F.col("pii_phone") + F.col("pii_ssn")).alias("pii_total"),
    )
    is_number, is_date = F.col("primitive_type") == "number", F.col("primitive_type") == "date"
    return (
        with_dataset(typed, dataset)
        .select(
            DATASET,
            positions[clean].alias("position"),
            originals[clean].alias("original_name"),
            clean.alias("clean_name"),
            "primitive_type", "semantic_hint",
            names.tags_expr(clean).alias("domain_tags"),
            "row_count", "non_null", "missing_pct", "distinct_count",
            "example_values", "top_values",
            "pii_email", "pii_phone", "pii_ssn",
            F.when(is_number, F.col("num_min")).alias("num_min"),
            F.when(is_number, F.col("num_max")).alias("num_max"),
            F.when(is_number, F.col("num_mean")).alias("num_mean"),
            F.when(is_date, F.col("date_min")).alias("date_min"),
            F.when(is_date, F.col("date_max")).alias("date_max"),
            column_notes().alias("notes"),
        )
    )


def column_notes() -> Column:
    parts = F.concat_ws(
        "; ",
        F.when(F.col("missing_pct") > rules.HIGH_MISSING_PCT, F.lit("High missing rate")),
        F.concat(F.lit("Semantic hint: "), F.col("semantic_hint")),
        F.when(F.col("pii_total") > 0, F.lit("Potential PII detected")),
    )
    return F.nullif(parts, F.lit(""))


def approximate_profile(df: DataFrame, *, dataset: str | Column = "dataset",
                        exclude: tuple[str, ...] = ()) -> DataFrame:
    """Row, missing and approximate distinct counts with sketches only.

    No value leaves its map task, so the cost is one scan whatever the cardinality.
    """
    source = [c for c in df.columns if c not in exclude]
    columns = dict(zip(source, names.standardize(source)))
    keys = keys_of(dataset)
    sketched = (
        cells(df, columns, dataset=dataset, with_row=False)
        .withColumn(VALUE, text.normalize_missing(F.col(VALUE)))
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("row_count"), F.count(VALUE).alias("non_null"),
             F.approx_count_distinct(VALUE).alias("distinct_count"))
    )
    missing = F.col("row_count") - F.col("non_null")
    return with_dataset(sketched, dataset).withColumn(
        "missing_pct", percent(missing, F.col("row_count")))


# --- per dataset ------------------------------------------------------------
def _names_where(flag: Column) -> Column:
    found = F.array_sort(F.collect_list(F.when(flag, F.struct("position", "clean_name"))))
    return F.transform(found, lambda x: x["clean_name"])


def profile_flags(profile: DataFrame) -> DataFrame:
    """Columns with many missing values, with PII, and with at most one value."""
    pii_total = F.col("pii_email") + F.col("pii_phone") + F.col("pii_ssn")
    return profile.groupBy(DATASET).agg(
        F.max("row_count").alias("row_count"),
        F.count(F.lit(1)).cast("int").alias("column_count"),
        _names_where(F.col("missing_pct") > rules.HIGH_MISSING_PCT).alias("columns_high_missing"),
        _names_where(pii_total > 0).alias("columns_with_pii"),
        _names_where(F.col("distinct_count") <= 1).alias("low_variance_columns"),
        F.count_if(F.col("primitive_type") == "unknown").alias("unknown_columns"),
    )


def _up_to(rows: DataFrame, place: str, limit: int | None) -> DataFrame:
    return rows if limit is None else rows.filter(F.col(place) <= limit)


def detect_domains(columns: DataFrame, name: str = "clean_name", position: str = "position",
                   evidence: int | None = None) -> DataFrame:
    """Domain scores of each dataset from its column names (one row per dataset and column)."""
    col = F.col(name)
    found = F.array(*[F.struct(F.lit(i).alias("domain_order"), F.lit(domain).alias("domain"),
                               F.lit(len(tokens)).alias("vocabulary"),
                               names.tags_expr(col, tokens).alias("tokens"))
                      for i, (domain, tokens) in enumerate(rules.DOMAINS)])
    hits = (
        columns.select(DATASET, F.col(position).alias("position"), col.alias("name"), F.inline(found))
        .filter(F.size("tokens") > 0)
    )
    # Tokens are counted as one flag bit each, so the aggregate state has a fixed size.
    per_domain = hits.groupBy(DATASET, "domain_order", "domain", "vocabulary").agg(
        F.sum(F.size("tokens")).alias("score"),
        F.count(F.lit(1)).alias("matched_columns"),
        sum((F.max(F.array_contains("tokens", t).cast("int"))
             for t in dict.fromkeys(t for _, ts in rules.DOMAINS for t in ts)), F.lit(0))
        .alias("matched_tokens"),
    )
    totals = columns.groupBy(DATASET).agg(F.count(F.lit(1)).alias("column_count"))
    order = W.partitionBy(DATASET, "domain").orderBy("position")
    proof = (
        _up_to(hits.withColumn("rank", F.row_number().over(order)), "rank", evidence)
        .groupBy(DATASET, "domain")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"])
             .alias("evidence_columns"))
    )
    confidence = (F.col("matched_tokens") / F.col("vocabulary") * 0.7
                  + F.col("matched_columns") / F.col("column_count") * 0.3)
    ranked = W.partitionBy(DATASET).orderBy(F.desc("score"), F.desc("confidence"), "domain_order")
    return (
        per_domain.join(totals, DATASET).join(proof, [DATASET, "domain"])
        .withColumn("confidence", F.bround(F.least(F.lit(1.0), confidence), 3))
        .withColumn("domain_rank", F.row_number().over(ranked))
        .select(DATASET, "domain_rank", "domain", "score", "confidence", "evidence_columns")
    )


# --- hints ------------------------------------------------------------------
def accepted_overrides(profile: DataFrame, proposals: DataFrame) -> DataFrame:
    """Proposed hints for known columns that are among the allowed hints."""
    return (
        proposals.filter(F.col("semantic_hint").isin(*rules.HINT_NAMES))
        .join(profile.select(DATASET, F.col("clean_name").alias(COLUMN)), [DATASET, COLUMN], "left_semi")
    )


def rejected_overrides(profile: DataFrame, proposals: DataFrame) -> DataFrame:
    known = profile.select(DATASET, F.col("clean_name").alias(COLUMN), F.lit(True).alias("known"))
    return (
        proposals.join(known, [DATASET, COLUMN], "left")
        .withColumn("reason", F.when(F.col("known").isNull(), F.lit("unknown column"))
                    .when(~F.col("semantic_hint").isin(*rules.HINT_NAMES), F.lit("unsupported hint")))
        .filter(F.col("reason").isNotNull()).drop("known")
    )


def column_hints(profile: DataFrame, proposals: DataFrame | None = None) -> DataFrame:
    """``(dataset_id, column_name, primitive_type, semantic_hint)`` after accepted overrides."""
    hints = profile.select(DATASET, F.col("clean_name").alias(COLUMN), "position",
                           "primitive_type", "semantic_hint")
    if proposals is None:
        return hints
    changed = accepted_overrides(profile, proposals).select(
        DATASET, COLUMN, F.col("semantic_hint").alias("override"))
    return (
        hints.join(changed, [DATASET, COLUMN], "left")
        .withColumn("semantic_hint", F.coalesce("override", "semantic_hint")).drop("override")
    )


def keep_and_drop(profile: DataFrame, proposals: DataFrame, limit: int | None = None) -> DataFrame:
    """Known columns to keep and, apart from those, to drop; the first ``limit`` of each if one is given.

    ``proposals`` has ``(dataset_id, column_name, list, rank)`` with list keep or drop.
    """
    known = profile.select(DATASET, F.col("clean_name").alias(COLUMN))
    valid = proposals.join(known, [DATASET, COLUMN], "left_semi")
    first = W.partitionBy(DATASET, "list").orderBy("rank", COLUMN)

    def cut(rows: DataFrame) -> DataFrame:
        return _up_to(rows.withColumn("place", F.row_number().over(first)), "place", limit).drop("rank")

    keep = cut(valid.filter(F.col("list") == "keep"))
    drop = valid.filter(F.col("list") == "drop").join(
        keep.select(DATASET, COLUMN), [DATASET, COLUMN], "left_anti")
    return keep.unionByName(cut(drop))
