"""Independent SQL oracle: the same operators written as portable SQL.

Each entry of :data:`ORACLE_SQL` is run by DuckDB over the raw test
tables; :func:`with_views` prefixes it with the fixture views it uses.
Output columns carry the same names and types as the Spark side, and the
numeric rules are the same S-rules (exact decimal sums, double averages
of exact sums, percent ratios divided as double and rounded to 2).
"""

from __future__ import annotations

import re

from oracle.fixture_sql import VIEWS
from oracle.queries import QUERIES


def _deps(sql: str) -> list[str]:
    words = set(re.findall(r"[a-z_][a-z0-9_]*", sql.lower()))
    return [v for v in VIEWS if v in words]


def with_views(sql: str) -> str:
    """Prefix ``sql`` with ``WITH`` clauses for every fixture view it needs,
    in dependency order (views only refer to earlier views)."""
    needed: set[str] = set()
    todo = _deps(sql)
    while todo:
        v = todo.pop()
        if v not in needed:
            needed.add(v)
            todo.extend(_deps(VIEWS[v]))
    ordered = [v for v in VIEWS if v in needed]
    if not ordered:
        return sql
    ctes = ",\n".join(f"{v} AS ({VIEWS[v]})" for v in ordered)
    body = sql.strip()
    if body.lower().startswith("with recursive "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body.lower().startswith("with "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def oracle_sql() -> dict[str, str]:
    return {name: with_views(sql) for name, sql in QUERIES.items()}
