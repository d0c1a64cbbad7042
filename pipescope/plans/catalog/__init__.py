"""Named queries over the star-schema tables, each with the SQL that must give the same rows."""

from pipescope.plans.catalog import analytics, bookkeeping, corpus, significance, sources  # noqa: F401
from pipescope.plans.catalog.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
