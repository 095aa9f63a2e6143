"""All queries of the library with their DuckDB SQL."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("relational", "analytics", "editorial", "inbox", "streams")


def _modules():
    return [import_module(f"loomwork.plans.{m}") for m in _MODULES]


def queries() -> dict:
    return {k: f for m in _modules() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in _modules() for k, s in m.ORACLE.items()}
