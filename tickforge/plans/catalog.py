"""Queries by name, and DuckDB SQL that gives the same rows."""

from __future__ import annotations

from . import market, series, volume

_ALL = {**volume.QUERIES, **market.QUERIES, **series.QUERIES}


def queries() -> dict:
    return {name: q for name, (q, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for name, (_, text) in _ALL.items()}
