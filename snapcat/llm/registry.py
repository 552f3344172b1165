"""Registered queries of this package and the DuckDB SQL each must equal, where SQL can express it."""

from __future__ import annotations

from snapcat.llm import bpe, decontaminate, filteraudit, importance, langid, licenses, puquality, quality, secrets, sharding, simhash, substring, tokencount

MODULES = (sharding, langid, secrets, tokencount, quality, bpe, licenses, decontaminate, substring, simhash, puquality, filteraudit, importance)


def all_queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def all_oracles() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
