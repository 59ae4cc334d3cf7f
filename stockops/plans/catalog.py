"""All registered queries."""

from __future__ import annotations

from importlib import import_module

from .registry import ORACLES, QUERIES

MODULES = ("relational", "decide", "text", "judge")


def queries() -> dict:
    for m in MODULES:
        import_module(f"{__package__}.{m}")
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(ORACLES)
