"""Spark-native profiling, cleaning, de-identification and readiness scoring of messy tables."""

from claritable.options import CleanOptions
from claritable.plans.cleaning import CleaningPlan, fit

__all__ = ["CleanOptions", "CleaningPlan", "fit"]
