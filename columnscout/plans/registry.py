"""All queries of the library's own operators, and their SQL twins."""

from __future__ import annotations

from columnscout.plans import catalogue, discovery, lake, matching, search_views

MODULES = (catalogue, lake, discovery, search_views, matching)


def queries() -> dict:
    return {name: query for m in MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
