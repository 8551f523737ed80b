"""All queries of the location engine, and the SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable

from geoloom.plans import columns, entities, extraction, grid, more, pages, sites
from geoloom.plans.columns import flagship

_MODULES = (columns, grid, entities, extraction, pages, more, sites)

__all__ = ["flagship", "oracle_sql", "queries"]


def queries() -> dict[str, Callable]:
    return {name: q for m in _MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
