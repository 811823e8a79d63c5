"""All registered queries and their SQL counterparts."""

from __future__ import annotations

from canvass.plans import describe, link, models

MODULES = (describe, link, models)


def queries() -> dict:
    return {name: fn for module in MODULES for name, fn in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
