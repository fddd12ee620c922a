"""Registered queries of the market-data operators."""

from __future__ import annotations

from . import derived, lake, operators, own, quality, scale  # noqa: F401
from .core import QUERIES, full_sql, runner


def queries() -> dict:
    return {name: runner(f) for name, (f, _, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: full_sql(sql, uses) for name, (_, sql, uses) in QUERIES.items() if sql}
