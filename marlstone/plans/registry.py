"""Collects queries: ``@query(sql)`` registers a function under its name together with its SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}
MODULES = ("projections", "joins", "aggregates", "windows", "encoders", "texts", "analytics", "exports", "variants", "rewriting", "roundtrips")


def tie_safe(sql: str) -> str:
    """SQL whose ``round(x, n)`` rounds as ``functions.numeric.rounded`` does."""
    out, at = [], 0
    while (start := sql.find("round(", at)) >= 0:
        if start and (sql[start - 1].isalnum() or sql[start - 1] == "_"):
            out.append(sql[at : start + 6])
            at = start + 6
            continue
        depth, comma, end = 1, 0, start + 6
        while depth:
            depth += {"(": 1, "[": 1, ")": -1, "]": -1}.get(sql[end], 0)
            if depth == 1 and sql[end] == ",":
                comma = end
            end += 1
        inside, digits = tie_safe(sql[start + 6 : comma]), int(sql[comma + 1 : end - 1])
        scale = float(10**digits)
        out.append(f"{sql[at:start]}(floor(cast({inside} as double) * {scale} + 0.500001) / {scale})")
        at = end
    return "".join(out) + sql[at:]


def query(sql: str | None = None) -> Callable:
    def register(f: Callable) -> Callable:
        name = f.__name__
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql:
            ORACLE[name] = tie_safe(sql)
        return f

    return register


def load() -> None:
    for m in MODULES:
        importlib.import_module(f"marlstone.plans.{m}")
