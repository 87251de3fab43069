"""All registered queries with their DuckDB SQL."""

from .plans import commands, journeys, library, media, moments, photos, streams  # noqa: F401 (they register their queries)
from .plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
