"""Where queries and their SQL twins are registered."""

from __future__ import annotations

from rankweave.core.contest import VIEW_SQL

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) under its name, with the SQL for the same rows."""

    def keep(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE[function.__name__] = sql
        return function

    return keep


def on_view(select: str, **tables: str) -> str:
    """SQL over the contest view v; tables: further common table expressions by name."""
    more = "".join(f",\n{name} AS ({body})" for name, body in tables.items())
    return f"WITH {VIEW_SQL}{more}\n{select}"
