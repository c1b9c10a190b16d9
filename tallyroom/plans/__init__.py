"""All queries by name."""

from tallyroom.plans import bills, bodies, controls, evidence, filings, intake, keys  # noqa: F401
from tallyroom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
