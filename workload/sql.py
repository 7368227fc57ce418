"""SQL fragments the checks are composed of."""

from __future__ import annotations

from claritable import rules
from workload.inputs import CLAIMS, MESSY, SEGMENT_MESSY


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def quoted(items) -> str:
    return ", ".join(quote(i) for i in items)


def strip(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def norm(c: str) -> str:
    return f"CASE WHEN lower({strip(c)}) IN ({quoted(rules.MISSING_TOKENS)}) THEN NULL ELSE {c} END"


def collapse(c: str) -> str:
    return strip(rf"regexp_replace({c}, '\s+', ' ', 'g')")


def digits(c: str) -> str:
    return rf"regexp_replace({c}, '\D+', '', 'g')"


NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def plain_number(c: str) -> str:
    return f"CASE WHEN regexp_matches({c}, '{NUMBER}') THEN TRY_CAST(trim({c}) AS DOUBLE) END"


def number(c: str) -> str:
    bare = rf"regexp_replace(replace(replace(replace({c}, ',', ''), '$', ''), '%', ''), '\(([^)]+)\)', '-\1', 'g')"
    return plain_number(f"({bare})")


def looks_numeric(c: str) -> str:
    return f"regexp_matches(replace(replace({c}, ',', ''), '$', ''), '{NUMBER}')"


def number_text(c: str) -> str:
    return rf"regexp_replace(CAST({c} AS VARCHAR), '\.0$', '')"


def timestamp(c: str) -> str:
    formats = quoted(("%Y-%m-%d", "%Y/%m/%d", "%m/%d/%Y", "%d-%b-%Y", "%Y-%m-%dT%H:%M:%SZ", "%Y-%m-%d %H:%M:%S"))
    late = f"try_strptime(replace({c}, 'T23:30:00-0500', ''), '%Y-%m-%d') + INTERVAL 28 HOUR + INTERVAL 30 MINUTE"
    return f"CASE WHEN {c} LIKE '%T23:30:00-0500' THEN {late} ELSE try_strptime({c}, [{formats}]) END"


def date_text(c: str) -> str:
    return f"strftime({timestamp(c)}, '%Y-%m-%d')"


def boolean(c: str) -> str:
    t = f"lower({strip(c)})"
    return (f"CASE WHEN {t} IN ({quoted(rules.TRUE_TOKENS)}) THEN true "
            f"WHEN {t} IN ({quoted(rules.FALSE_TOKENS)}) THEN false END")


def looks_boolean(c: str) -> str:
    return f"lower({strip(c)}) IN ({quoted(rules.TRUE_TOKENS + rules.FALSE_TOKENS)})"


def matches(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, {quote(pattern)})"


def redact(c: str) -> str:
    for pattern, label in ((rules.EMAIL, rules.REDACTED_EMAIL), (rules.PHONE, rules.REDACTED_PHONE),
                           (rules.SSN, rules.REDACTED_SSN)):
        c = f"regexp_replace({c}, {quote(pattern)}, {quote(label)}, 'g')"
    return c


def phone(c: str) -> str:
    return f"nullif(right({digits(c)}, 10), '')"


def postal(c: str) -> str:
    return f"nullif(left({digits(c)}, 5), '')"


def ndc(c: str) -> str:
    d = digits(c)
    return f"CASE WHEN length({d}) = 10 THEN '0' || {d} ELSE nullif({d}, '') END"


def rxnorm(c: str) -> str:
    return f"nullif({digits(c)}, '')"


def compact(c: str) -> str:
    return f"upper(replace({c}, ' ', ''))"


def gender(c: str) -> str:
    cases = " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in rules.GENDER_VALUES.items())
    return f"CASE lower({strip(c)}) {cases} ELSE {c} END"


def zip3(c: str) -> str:
    return f"CASE WHEN length({digits(c)}) >= 3 THEN left({digits(c)}, 3) || '00' END"


def any_token(c: str, tokens) -> str:
    return "(" + " OR ".join(f"contains({c}, {quote(t)})" for t in tokens) + ")"


def hint(c: str, classes=rules.SEMANTIC_HINTS) -> str:
    return "CASE " + " ".join(f"WHEN {any_token(c, t)} THEN {quote(h)}" for h, t in classes) + " END"


def cells(view: str, columns, ids: str = "row_id") -> str:
    return " UNION ALL ".join(
        f"SELECT {ids}, {i} AS position, {quote(c)} AS column_name, {c} AS value FROM {view}"
        for i, c in enumerate(columns))


def pct(part: str, whole: str, digits_: int = 2) -> str:
    return (f"round_even(CASE WHEN {whole} > 0 THEN CAST({part} AS DOUBLE) / CAST({whole} AS DOUBLE) "
            f"ELSE 0 END * 100, {digits_})")


WITH_MESSY = f"WITH messy AS ({MESSY})"
WITH_CLAIMS = f"WITH claims AS ({CLAIMS})"
WITH_SEGMENTS = f"WITH messy AS ({SEGMENT_MESSY})"
