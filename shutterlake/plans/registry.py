"""Where queries register, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from ..sources.views import with_views

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

#: The present, wherever a query needs one.
AS_OF = "2026-01-15 00:00:00"


def query(sql: str | None = None):
    """Registers a query; without SQL, tests hold it against brute force."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = with_views(sql)
        return f

    return put
