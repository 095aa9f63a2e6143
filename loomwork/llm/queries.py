"""Registry of the operators' queries and their SQL."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("sharding", "quality", "topk", "jaccard", "substring", "toxicity", "packing", "mixing", "ann", "html", "audit", "repair", "pieces")


_LOADED = [import_module(f"loomwork.llm.{m}") for m in _MODULES]


def queries() -> dict:
    return {k: f for m in _LOADED for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in _LOADED for k, s in m.ORACLE.items()}
