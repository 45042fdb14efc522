"""All core queries and their SQL."""

from __future__ import annotations

from loomtext.plans import core, corpus, editing, units, workbench

MODULES = (core, corpus, units, editing, workbench)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
