"""Cleaning options: defaults, validation and the effect of performance modes."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field, replace

PERFORMANCE_MODES = ("balanced", "fast", "ultra_fast")
PRIVACY_MODES = ("none", "safe_harbor")
COERCION_MODES = ("safe", "strict")
TEXT_CASES = ("none", "lower", "upper", "title")
SHARED_USES = ("training", "external_share")


def utc_today() -> dt.date:
    return dt.datetime.now(dt.timezone.utc).date()


@dataclass(frozen=True)
class CleanOptions:
    """Arguments of ``fit``.  Every rule that depends on today reads ``as_of``."""

    remove_duplicates: bool = True
    drop_empty_columns: bool = True
    deidentify: bool = False
    normalize_missing: bool = True
    sanitize: bool = True
    normalize_phone: bool = True
    normalize_postal: bool = True
    normalize_gender: bool = True
    text_case: str = "none"
    coercion: str = "safe"
    privacy: str = "none"
    performance: str = "balanced"
    # Identifiers, postal codes, phones, SSNs and codes keep their leading zeros.
    # Set False to coerce them by value like any other column.
    protect_identifiers: bool = True
    as_of: dt.date = field(default_factory=utc_today)

    def __post_init__(self):
        for name, allowed in (("performance", PERFORMANCE_MODES), ("privacy", PRIVACY_MODES),
                              ("coercion", COERCION_MODES), ("text_case", TEXT_CASES)):
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} must be one of {allowed}, got {getattr(self, name)!r}")

    @classmethod
    def for_use(cls, usage_intent: str = "training", *, privacy: str | None = None,
                deidentify: bool | None = None, **changes) -> "CleanOptions":
        """Defaults by intended use: shared data is redacted and Safe-Harbor masked.

        An explicit ``deidentify`` decides the privacy mode too.
        """
        shared = usage_intent in SHARED_USES
        mode = privacy or "safe_harbor"
        if deidentify is not None:
            mode = "safe_harbor" if deidentify else "none"
        options = cls(deidentify=shared if deidentify is None else deidentify, privacy=mode,
                      **changes)
        return options.resolved()

    def resolved(self, *, streaming: bool = False) -> "CleanOptions":
        """Options after the performance mode has switched steps off."""
        if self.performance != "ultra_fast":
            return self
        return replace(self, sanitize=False, normalize_phone=False, normalize_postal=False,
                       normalize_gender=False, text_case="none",
                       normalize_missing=self.normalize_missing and not streaming)

    @property
    def validates(self) -> bool:
        return self.performance == "balanced"

    def to_dict(self) -> dict:
        values = dict(self.__dict__)
        values["as_of"] = self.as_of.isoformat()
        return values

    @classmethod
    def from_dict(cls, values: dict) -> "CleanOptions":
        values = dict(values)
        values["as_of"] = dt.date.fromisoformat(values["as_of"])
        return cls(**values)
