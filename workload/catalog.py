"""All registered queries."""

from workload import cleaning, files, history, profiles, scores  # noqa: F401
from workload.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
