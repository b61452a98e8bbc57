"""All named queries of the library, without those of the subpackages that add their own."""

from __future__ import annotations

from . import panels, quality

MODULES = [quality, panels]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in m.SQL.items()}
