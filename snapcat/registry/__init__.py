"""Registered queries and the DuckDB SQL each must equal."""

from __future__ import annotations

from snapcat.registry import catalog, docs, facts, given, rows

MODULES = (catalog, facts, rows, docs, given)


def all_queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def all_oracles() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.oracles().items()}
