"""All queries of the library itself, and the SQL that checks them."""

from __future__ import annotations

from .plans import flows, further, registry, relations, scalars, searches, stored  # noqa: F401  they register their queries


def queries() -> dict:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
