"""All queries over the driver's tables and their DuckDB equivalents."""

from __future__ import annotations

from .plans import cycles, live, market, reports, series, views  # noqa: F401  registering is what the import is for
from .plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
