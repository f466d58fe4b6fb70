"""Registered queries and their SQL."""

from fleetlens.plans import catalog, daily, extra, files, more, reports, sequences, series, sessions  # noqa: F401
from fleetlens.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
