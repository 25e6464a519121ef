"""All registered queries of the core."""

from __future__ import annotations

from ripplework.plans import coordination, profile, skew, timeseries

_MODULES = (profile, timeseries, coordination, skew)


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
