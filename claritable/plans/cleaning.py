"""``fit`` a cleaning plan from the data, then apply it as one projection.

Fitting is one aggregation that returns one row per column.  The plan it produces is
small, serialisable and fixes the output schema, so the same plan cleans a batch table
and every micro-batch of a stream.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Mapping
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claritable import rules
from claritable.functions import coerce, names, text
from claritable.operators import dedup, privacy
from claritable.operators.cells import COLUMN, DATASET, as_text
from claritable.operators.profile import profile_columns
from claritable.options import CleanOptions
from claritable.sources.scratch import materialize

NUMBER, DATE, BOOLEAN, STRING = "number", "date", "boolean", "string"
_PRIMITIVES = {"integer": NUMBER, "float": NUMBER, "number": NUMBER, "date": DATE,
               "datetime": DATE, "bool": BOOLEAN, "boolean": BOOLEAN}
_READERS = {
    NUMBER: lambda c, as_of: coerce.number(c),
    DATE: coerce.date,
    BOOLEAN: lambda c, as_of: coerce.boolean(c),
}
_WRITERS = {
    NUMBER: coerce.number_to_text,
    DATE: coerce.date_to_text,
    BOOLEAN: lambda c: c.cast("string"),
}
# Hints whose values are labels, with the tokens that must stand alone in the name: a
# hint found inside another word (``paid`` holds ``id``) does not make a label.
_IDENTIFIERS = {
    "id": ("id", "uuid", "mrn", "patient", "claim", "member"), "claim_id": ("claim_id",),
    "member_id": ("member_id", "subscriber", "policy"),
    "code": ("code", "icd", "cpt", "ndc", "loinc", "drg", "hcpcs", "rxnorm"),
    "provider": ("npi",),
    "phone": ("phone", "mobile", "tel", "cell"), "ssn": ("ssn", "social"),
    "postal_code": ("zip", "postal"),
}


def read_typed(primitive: str, c: Column, as_of: dt.date) -> Column:
    return _READERS[primitive](c, as_of)


@dataclass(frozen=True)
class ColumnSpec:
    """What is known about a column before the data is measured."""

    original: str
    name: str
    position: int
    primitive: str
    hint: str | None

    def mode(self, options: CleanOptions) -> str:
        return "safe" if self.hint in rules.CRITICAL_DATE_HINTS else options.coercion

    def digit_steps(self, options: CleanOptions) -> list:
        """Normalizers that can empty a value."""
        steps = []
        if "ndc" in self.name:
            steps.append(text.normalize_ndc)
        if "rxnorm" in self.name:
            steps.append(text.normalize_rxnorm)
        if self.hint == "phone" and options.normalize_phone:
            steps.append(text.normalize_phone)
        if self.hint == "postal_code" and options.normalize_postal:
            steps.append(text.normalize_postal)
        return steps

    def label_steps(self, options: CleanOptions) -> list:
        """All text normalizers in order."""
        steps = []
        if self.hint in ("code", "medication", "lab") or "loinc" in self.name:
            steps.append(text.compact_code)
        steps += self.digit_steps(options)
        if self.hint == "gender" and options.normalize_gender:
            steps.append(text.normalize_gender)
        if options.text_case != "none" and self.primitive == STRING and self.hint != "code":
            steps.append(lambda c: text.text_case(c, options.text_case))
        return steps

    def raw(self, df: DataFrame, options: CleanOptions) -> Column:
        cell = as_text(df, self.original)
        return text.normalize_missing(cell) if options.normalize_missing else cell

    def cell(self, raw: Column, options: CleanOptions, *, typed: bool, keep_invalid: bool,
             parsed: Column | None = None) -> Column:
        """The cleaned cell, typed unless unparsed text or a label format stands in it.

        ``parsed`` is the typed reading where a projection below has it already.
        """
        sanitized = text.collapse(raw) if options.sanitize else raw
        steps = self.label_steps(options)
        if typed:
            out = read_typed(self.primitive, raw, options.as_of) if parsed is None else parsed
            if keep_invalid:
                out = F.coalesce(_WRITERS[self.primitive](out), sanitized)
            elif steps:
                out = _WRITERS[self.primitive](out)
        else:
            out = sanitized
        for step in steps:
            out = step(out)
        return out


def column_specs(columns: list[str], hints: Mapping[str, tuple], options: CleanOptions,
                 exclude: tuple[str, ...] = ()) -> list[ColumnSpec]:
    """Specs from ``{clean_name: (primitive_type, semantic_hint)}``."""
    source = [c for c in columns if c not in exclude]
    specs = []
    for position, (original, name) in enumerate(zip(source, names.standardize(source))):
        primitive, hint = hints.get(name, (STRING, None))
        primitive = _PRIMITIVES.get(primitive or STRING, STRING)
        hint = hint or names.fallback_hint(name)
        if options.performance == "ultra_fast":
            primitive = STRING
        if hint in rules.CRITICAL_DATE_HINTS and primitive == STRING:
            primitive = DATE
        if (options.protect_identifiers and primitive in (NUMBER, DATE)
                and hint in _IDENTIFIERS and names.has_token(name, _IDENTIFIERS[hint])):
            primitive = STRING
        specs.append(ColumnSpec(original, name, position, primitive, hint))
    return specs


def measure_conversion(df: DataFrame, specs: list[ColumnSpec], options: CleanOptions,
                       dataset: str = "dataset") -> DataFrame:
    """One row per column: how much of it parses, and what becomes of it.

    A single aggregate over one scan; every column adds two to four counts.
    """
    counts = []
    raws = df.select(*[spec.raw(df, options).alias(f"r{spec.position}") for spec in specs])
    for spec in specs:
        key, raw = spec.position, F.col(f"r{spec.position}")
        typed, narrowing = spec.primitive != STRING, bool(spec.digit_steps(options))
        counts.append(F.count(raw).alias(f"n{key}"))
        if narrowing:
            counts.append(F.count(spec.cell(raw, options, typed=False, keep_invalid=False)).alias(f"t{key}"))
        if typed:
            counts.append(F.count(read_typed(spec.primitive, raw, options.as_of)).alias(f"p{key}"))
        if typed and narrowing:
            keep = spec.mode(options) == "safe"
            counts.append(F.count(spec.cell(raw, options, typed=True, keep_invalid=keep)).alias(f"k{key}"))
    return _conversion(raws.agg(F.count(F.lit(1)).alias("_rows"), *counts), specs, options, dataset)


def _conversion(totals: DataFrame, specs: list[ColumnSpec], options: CleanOptions, dataset: str) -> DataFrame:
    """One row per column from its counts: ``n`` filled, ``t`` kept as text, ``p`` parsed and ``k`` kept as typed."""
    entries = []
    harbor = options.privacy == "safe_harbor"
    for spec in specs:
        rule = privacy.safe_harbor_rule(spec.name, spec.hint) if harbor else None
        key = spec.position
        non_null = F.col(f"n{key}")
        typed = spec.primitive != STRING
        keep = spec.mode(options) == "safe"
        narrowing = bool(spec.digit_steps(options))

        kept_text, kept_typed, parsed = non_null, non_null, non_null
        if narrowing:
            kept_text = F.col(f"t{key}")
        if typed:
            parsed = F.col(f"p{key}")
            kept_typed = non_null if keep else parsed
            if narrowing:
                kept_typed = F.col(f"k{key}")

        success = F.when(non_null > 0, parsed / non_null).otherwise(F.lit(0.0))
        skipped = F.lit(typed) & (success < rules.MIN_PARSE_SUCCESS)
        gated = F.lit(not typed) | skipped
        entries.append(F.struct(
            F.lit(key).alias("position"), F.lit(spec.original).alias("original_name"),
            F.lit(spec.name).alias(COLUMN),
            F.lit(spec.primitive).alias("primitive_type"),
            F.lit(spec.hint).cast("string").alias("semantic_hint"),
            F.when(gated, F.lit(STRING)).otherwise(F.lit(spec.primitive)).alias("target_type"),
            non_null.alias("non_null"),
            (non_null - parsed if typed else F.lit(0).cast("bigint")).alias("invalid"),
            F.when(F.lit(typed), F.bround(success, 3)).alias("success_ratio"),
            F.when(~gated, F.lit(spec.mode(options))).alias("coercion_mode"),
            skipped.alias("coercion_skipped"),
            F.lit(rule[0] if rule else None).cast("string").alias("privacy_transform"),
            (F.when(gated, kept_text).otherwise(kept_typed) == 0).alias("empty"),
        ))
    measured = totals.select("_rows", F.inline(F.array(*entries)))
    return measured.select(
        F.lit(dataset).alias(DATASET), F.col("_rows").alias("row_count"),
        *[c for c in measured.columns if c not in ("_rows", "empty")],
        # An empty table keeps its schema.
        (F.col("empty") & (F.col("_rows") > 0) & F.lit(options.drop_empty_columns)).alias("dropped_empty"),
    )


@dataclass(frozen=True)
class ColumnPlan:
    original: str
    name: str
    position: int
    primitive: str
    hint: str | None
    target: str
    non_null: int
    invalid: int
    success_ratio: float | None
    mode: str | None
    skipped: bool
    dropped: bool
    transform: str | None

    @property
    def spec(self) -> ColumnSpec:
        return ColumnSpec(self.original, self.name, self.position, self.primitive, self.hint)


@dataclass(frozen=True)
class CleaningPlan:
    columns: tuple[ColumnPlan, ...]
    options: CleanOptions
    row_count: int
    dataset: str = "dataset"

    # --- applying -----------------------------------------------------------
    def project(self, df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
        """Rename, normalize, coerce and drop empty columns; no shuffle."""
        # Missing values are settled in a projection of their own, and typed readings in another: the cells read
        # the results many times, and Spark keeps them apart instead of repeating them.
        own, typed = [F.col(k) for k in keys], [c for c in self.kept() if c.target != STRING]
        raw = df.select(*own, *[c.spec.raw(df, self.options).alias(f"r:{c.name}") for c in self.kept()])
        raw = raw.select("*", *[read_typed(c.primitive, F.col(f"`r:{c.name}`"), self.options.as_of)
                                .alias(f"p:{c.name}") for c in typed])
        parsed = lambda c: F.col(f"`p:{c.name}`") if c in typed else None
        return raw.select(*own, *[self.cell(c, F.col(f"`r:{c.name}`"), parsed(c)).alias(c.name) for c in self.kept()])

    def cell(self, column: ColumnPlan, raw: Column, parsed: Column | None = None) -> Column:
        return column.spec.cell(raw, self.options, typed=column.target != STRING,
                                keep_invalid=column.mode == "safe" and column.invalid > 0, parsed=parsed)

    def project_flagged(self, df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
        """``project`` with ``missing:<name>`` of every raw cell and ``invalid:<name>`` of every typed one.

        Raw cells and their typed readings are settled in projections of their own, so that
        cells and flags read them without computing them again.
        """
        own, typed = [F.col(k) for k in keys], [c for c in self.columns if c.primitive != STRING]
        rows = df.select(*own, *[c.spec.raw(df, self.options).alias(f"r:{c.name}") for c in self.columns])
        rows = rows.select("*", *[read_typed(c.primitive, F.col(f"`r:{c.name}`"), self.options.as_of)
                                  .alias(f"p:{c.name}") for c in typed])
        raw = lambda c: F.col(f"`r:{c.name}`")
        parsed = lambda c: F.col(f"`p:{c.name}`")
        return rows.select(
            *own, *[self.cell(c, raw(c), parsed(c) if c in typed else None).alias(c.name) for c in self.kept()],
            *[raw(c).isNull().alias(f"missing:{c.name}") for c in self.columns],
            *[(raw(c).isNotNull() & parsed(c).isNull()).alias(f"invalid:{c.name}") for c in typed])

    def privatize(self, df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
        """De-identify projected rows."""
        return privacy.deidentify(
            df, {c.name: c.hint for c in self.columns}, self.options.as_of,
            redact=self.options.deidentify, harbor=self.options.privacy == "safe_harbor", keep=keys)

    def transform(self, df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
        """Row-wise cleaning, the same for batch and streaming DataFrames."""
        return self.privatize(self.project(df, keys), keys)

    def clean(self, df: DataFrame, row_key: str | None = None) -> DataFrame:
        """The whole clean: project, deduplicate, de-identify.

        With ``row_key`` the first copy of each row stays and its key is kept.
        """
        keys = (row_key,) if row_key else ()
        rows = self.project(df, keys)
        if self.options.remove_duplicates:
            rows = dedup.drop_duplicates(rows, keep_first=row_key)
        return self.privatize(rows, keys)

    # --- reading ------------------------------------------------------------
    def kept(self) -> list[ColumnPlan]:
        return [c for c in self.columns if not c.dropped]

    @property
    def column_map(self) -> dict[str, str]:
        return {c.original: c.name for c in self.columns}

    @property
    def hints(self) -> dict[str, str | None]:
        return {c.name: c.hint for c in self.columns}

    @property
    def empty_columns(self) -> list[str]:
        return [c.name for c in self.columns if c.dropped]

    @property
    def invalid_values(self) -> dict[str, int]:
        return {c.name: c.invalid for c in self.columns}

    def conversion(self, spark: SparkSession) -> DataFrame:
        """The ``plan_columns`` report: one row per column."""
        rows = [(self.dataset, self.row_count, c.position, c.original, c.name, c.primitive, c.hint,
                 c.target, c.non_null, c.invalid, c.success_ratio, c.mode, c.skipped, c.dropped,
                 c.transform) for c in self.columns]
        return spark.createDataFrame(rows, (
            "dataset_id string, row_count bigint, position int, original_name string, "
            "column_name string, primitive_type string, semantic_hint string, target_type string, "
            "non_null bigint, invalid bigint, success_ratio double, coercion_mode string, "
            "coercion_skipped boolean, dropped_empty boolean, privacy_transform string"))

    def to_json(self) -> str:
        return json.dumps({"dataset": self.dataset, "row_count": self.row_count,
                           "options": self.options.to_dict(),
                           "columns": [asdict(c) for c in self.columns]})

    @classmethod
    def from_json(cls, payload: str) -> "CleaningPlan":
        data = json.loads(payload)
        return cls(tuple(ColumnPlan(**c) for c in data["columns"]),
                   CleanOptions.from_dict(data["options"]), data["row_count"], data["dataset"])


def infer_hints(df: DataFrame, as_of: dt.date, exclude: tuple[str, ...] = (),
                **profile_options) -> dict[str, tuple[str, str | None]]:
    """``{clean_name: (primitive_type, semantic_hint)}``; one row per column reaches the driver."""
    profile = profile_columns(df, as_of=as_of, exclude=exclude, **profile_options)
    rows = profile.select("clean_name", "primitive_type", "semantic_hint").collect()
    return {r["clean_name"]: (r["primitive_type"], r["semantic_hint"]) for r in rows}


def fit(df: DataFrame, options: CleanOptions | None = None, *,
        hints: Mapping[str, tuple] | None = None, exclude: tuple[str, ...] = (),
        dataset: str = "dataset", streaming: bool = False) -> CleaningPlan:
    """Measure ``df`` and decide, per column, type, coercion, dropping and masking."""
    options = (options or CleanOptions()).resolved(streaming=streaming)
    specs = _specs(df, options, hints, exclude)
    return _planned(measure_conversion(df, specs, options, dataset), options, dataset)


def _specs(df: DataFrame, options: CleanOptions, hints: Mapping[str, tuple] | None,
           exclude: tuple[str, ...]) -> list[ColumnSpec]:
    if hints is None:
        hints = infer_hints(df, options.as_of, exclude)
    return column_specs(df.columns, hints, options, exclude)


def _planned(measured: DataFrame, options: CleanOptions, dataset: str) -> CleaningPlan:
    columns, row_count = [], 0
    for row in measured.collect():
        row_count = row["row_count"]
        columns.append(ColumnPlan(
            original=row["original_name"], name=row[COLUMN], position=row["position"],
            primitive=row["primitive_type"], hint=row["semantic_hint"], target=row["target_type"],
            non_null=row["non_null"], invalid=row["invalid"], success_ratio=row["success_ratio"],
            mode=row["coercion_mode"], skipped=row["coercion_skipped"],
            dropped=row["dropped_empty"], transform=row["privacy_transform"]))
    return CleaningPlan(tuple(columns), options, row_count, dataset)


# --- fit and clean in one pass ------------------------------------------------
_COPIES, _CHANGED = "n:", "o:"


def settles(specs: list[ColumnSpec], options: CleanOptions) -> bool:
    """True where a typed cell is its reading or its kept text, so that settled rows hold all that a fit may decide on."""
    return options.remove_duplicates and all(
        spec.mode(options) == "safe" and not spec.label_steps(options) for spec in specs if spec.primitive != STRING)


def settle(df: DataFrame, specs: list[ColumnSpec], options: CleanOptions, row_key: str | None = None) -> DataFrame:
    """Distinct rows of ``c:<name>`` and ``p:<name>`` with their copies, before anything is known about the columns.

    ``c:`` is the cell if its column passes the gate and keeps unparsed text, ``p:`` its typed reading, and ``f:`` counts
    the copies whose raw cell was filled where a normalizer can empty it. ``o:`` counts the copies with unparsed text
    that was changed.
    """
    own, typed = [F.col(row_key)] if row_key else [], [s for s in specs if s.primitive != STRING]
    narrowing = [s for s in specs if s.digit_steps(options)]
    # Raw cells and typed readings are settled in projections of their own, as in ``CleaningPlan.project``.
    raw = lambda s: F.col(f"`r:{s.name}`")
    parsed = lambda s: F.col(f"`p:{s.name}`") if s in typed else None
    rows = df.select(*own, *[s.raw(df, options).alias(f"r:{s.name}") for s in specs])
    rows = rows.select("*", *[read_typed(s.primitive, raw(s), options.as_of).alias(f"p:{s.name}") for s in typed])
    changed = F.lit(False)
    for s in typed:
        changed |= parsed(s).isNull() & ~raw(s).eqNullSafe(text.collapse(raw(s)) if options.sanitize else raw(s))
    rows = rows.select(
        *own, *[s.cell(raw(s), options, typed=s in typed, keep_invalid=True, parsed=parsed(s)).alias(f"c:{s.name}") for s in specs],
        *[parsed(s) for s in typed], *[raw(s).isNotNull().alias(f"f:{s.name}") for s in narrowing], changed.alias(_CHANGED))
    keys = [*[f"`c:{s.name}`" for s in specs], *[f"`p:{s.name}`" for s in typed]]
    flags = [_CHANGED, *[f"f:{s.name}" for s in narrowing]]
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias(_COPIES), *[F.count_if(F.col(f"`{flag}`")).alias(flag) for flag in flags],
        *[F.min(row_key).alias(row_key) for _ in own])


def _may_meet(spec: ColumnSpec, cell: Column, parsed: Column, as_of: dt.date) -> Column:
    """True where another reading may have this cell, or another cell this reading.

    Cells written from readings tell them apart, but for the years before 1 and zeros with a sign; unparsed text is like
    none of them unless it can be read once its spaces are collapsed, or where a reading is written as no reading is read.
    """
    odd = parsed.isNull() & (F.col(f"`{_CHANGED}`") > 0) & read_typed(spec.primitive, cell, as_of).isNotNull()
    if spec.primitive == NUMBER:
        odd |= ((parsed == 0) & (cell != "0")) | (F.abs(parsed) == F.lit(float("inf"))) | F.isnan(parsed)
    if spec.primitive == DATE:
        odd |= ~parsed.between(F.lit("0001-01-01").cast("date"), F.lit("9999-12-31").cast("date"))
    return F.coalesce(odd, F.lit(False))


def fit_settled(settled: DataFrame, specs: list[ColumnSpec], options: CleanOptions,
                dataset: str = "dataset") -> tuple[CleaningPlan, bool]:
    """The plan that :func:`fit` makes of the rows behind ``settled``, and whether its rows stay distinct as cells."""
    copies = F.col(f"`{_COPIES}`")
    total = lambda n: F.coalesce(F.sum(n), F.lit(0))
    counts, odd = [], F.lit(False)
    for spec in specs:
        key, cell, parsed = spec.position, F.col(f"`c:{spec.name}`"), F.col(f"`p:{spec.name}`")
        filled = total(F.when(cell.isNotNull(), copies))
        if spec.digit_steps(options):
            counts += [total(F.col(f"`f:{spec.name}`")).alias(f"n{key}"), filled.alias(f"t{key}")]
        else:
            counts.append(filled.alias(f"n{key}"))
        if spec.primitive != STRING:
            counts.append(total(F.when(parsed.isNotNull(), copies)).alias(f"p{key}"))
            odd |= _may_meet(spec, cell, parsed, options.as_of)
    # A row for the whole table: read twice, by the plan and by the flag.
    totals = settled.agg(total(copies).alias("_rows"), *counts, F.count_if(odd).alias("_odd"))
    row = totals.first()
    totals = settled.sparkSession.createDataFrame([row], totals.schema)
    return _planned(_conversion(totals, specs, options, dataset), options, dataset), row["_odd"] == 0


def settled_cells(plan: CleaningPlan, settled: DataFrame, row_key: str | None = None) -> DataFrame | None:
    """The cells of ``plan`` from settled rows; None where a column failed its gate, whose text they do not hold."""
    if any(c.skipped for c in plan.columns):
        return None
    def cell(c: ColumnPlan) -> Column:
        return F.col(f"`{'c' if c.target == STRING or c.invalid > 0 else 'p'}:{c.name}`").alias(c.name)

    return settled.select(*([row_key] if row_key else []), *[cell(c) for c in plan.kept()])


def fit_and_clean(df: DataFrame, options: CleanOptions, *, hints: Mapping[str, tuple] | None = None,
                  exclude: tuple[str, ...] = (), dataset: str = "dataset",
                  row_key: str | None = None) -> tuple[CleaningPlan, DataFrame]:
    """``fit`` and the distinct projected rows, written once; raw cells are read once where settled rows allow it."""
    options = options.resolved()
    specs, keys = _specs(df, options, hints, exclude), (row_key,) if row_key else ()
    if settles(specs, options):
        settled = materialize(settle(df, specs, options, row_key), "settled")
        plan, distinct = fit_settled(settled, specs, options, dataset)
        rows = settled_cells(plan, settled, row_key)
        if rows is not None and distinct:
            return plan, rows
    else:
        plan, rows = _planned(measure_conversion(df, specs, options, dataset), options, dataset), None
    if rows is None:
        rows = plan.project(df, keys)
    if options.remove_duplicates:
        rows = dedup.drop_duplicates(rows, keep_first=row_key)
    return plan, materialize(rows, "projected")
