"""The registered queries: one for each operator, with the SQL it is held against."""

from __future__ import annotations

from marlstone.plans.registry import ORACLE, QUERIES, load

FLAGSHIP = "w07_trailing_window"


def queries() -> dict:
    load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    load()
    return dict(ORACLE)
