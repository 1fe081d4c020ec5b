"""All registered queries of the core, and the SQL each is compared with."""

from __future__ import annotations

from lorebase.plans import composite, extras, hygiene, relational, retrieval, scalars

MODULES = (hygiene, relational, scalars, retrieval, composite, extras)
FLAGSHIP = "search_hybrid"


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
