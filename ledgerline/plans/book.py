"""A family of queries and their statements, side by side."""

from __future__ import annotations


def book() -> tuple[dict, dict, object]:
    """(queries, statements, decorator): the decorator takes the statement, or nothing where SQL cannot express the query."""
    queries: dict = {}
    statements: dict[str, str] = {}

    def query(sql: str | None = None):  # noqa: ANN202
        def add(f):  # noqa: ANN001, ANN202
            queries[f.__name__] = f
            if sql is not None:
                statements[f.__name__] = sql
            return f

        return add

    return queries, statements, query
