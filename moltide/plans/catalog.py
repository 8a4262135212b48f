"""All core queries and their SQL."""

from __future__ import annotations

from moltide.plans import contacts, data_quality, dynamics, structure

MODULES = (structure, dynamics, contacts, data_quality)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
