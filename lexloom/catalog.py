"""All queries of the library with their SQL oracles, by name."""

from __future__ import annotations

from lexloom.plans import analytics, committee, derived, files, regulation, stored, texts  # noqa: F401  they register themselves
from lexloom.plans.registry import FIXTURE_ORACLES, FIXTURES, ORACLES, QUERIES

__all__ = ["FIXTURES", "FIXTURE_ORACLES", "ORACLES", "QUERIES"]
