"""Rules over column names, as plain functions for one schema and as column
expressions for a table of column names (one row per dataset and column)."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from claritable import rules


# --- one schema -------------------------------------------------------------
def snake_case(name: str) -> str:
    return re.sub(r"[^a-zA-Z0-9]+", "_", name).strip("_").lower() or "column"


def standardize(names: Iterable[str]) -> list[str]:
    """Clean, unique names in column order; a taken name gets ``_2``, ``_3``..."""
    taken: set[str] = set()
    result = []
    for name in names:
        base = snake_case(name)
        choice, suffix = base, 1
        while choice in taken:
            suffix += 1
            choice = f"{base}_{suffix}"
        taken.add(choice)
        result.append(choice)
    return result


def contains_any(name: str, tokens: Iterable[str]) -> bool:
    return any(token in name.lower() for token in tokens)


def has_token(name: str, tokens: Iterable[str]) -> bool:
    """Token match on ``_`` boundaries only."""
    padded = f"_{snake_case(name)}_"
    return any(f"_{snake_case(token)}_" in padded for token in tokens)


def hint_for(name: str, match: str = "substring") -> str | None:
    """First hint class with a token in the name.

    ``match="token"`` compares whole ``_``-separated tokens, which avoids readings
    such as ``provider`` -> ``id``.
    """
    test = has_token if match == "token" else contains_any
    return next((hint for hint, tokens in rules.SEMANTIC_HINTS if test(name, tokens)), None)


def fallback_hint(name: str) -> str | None:
    return next((hint for hint, tokens in rules.FALLBACK_HINTS if contains_any(name, tokens)), None)


def domain_tags(name: str) -> list[str]:
    return [tag for tag in rules.DOMAIN_TAGS if tag in name.lower()]


# --- a table of column names ------------------------------------------------
def any_token(name: Column, tokens: Iterable[str]) -> Column:
    return F.lower(name).rlike("|".join(re.escape(token) for token in tokens))


def any_whole_token(name: Column, tokens: Iterable[str]) -> Column:
    choices = "|".join(re.escape(snake_case(token)) for token in tokens)
    return snake_case_expr(name).rlike(f"(?:^|_)(?:{choices})(?:_|$)")


def snake_case_expr(name: Column) -> Column:
    cleaned = F.lower(F.btrim(F.regexp_replace(name, r"[^a-zA-Z0-9]+", "_"), F.lit("_")))
    return F.when(cleaned == "", F.lit("column")).otherwise(cleaned)


def _first_class(name: Column, classes) -> Column:
    chain = F.when(any_token(name, classes[0][1]), F.lit(classes[0][0]))
    for hint, tokens in classes[1:]:
        chain = chain.when(any_token(name, tokens), F.lit(hint))
    return chain


def hint_expr(name: Column) -> Column:
    return _first_class(name, rules.SEMANTIC_HINTS)


def fallback_hint_expr(name: Column) -> Column:
    return _first_class(name, rules.FALLBACK_HINTS)


def tags_expr(name: Column, tokens: Iterable[str] = rules.DOMAIN_TAGS) -> Column:
    """Array of the tokens found in the name, in the given order."""
    found = [F.when(F.contains(F.lower(name), F.lit(t)), F.lit(t)) for t in tokens]
    return F.array_compact(F.array(*found))
