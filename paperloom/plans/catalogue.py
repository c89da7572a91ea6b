"""All queries of the library."""

from __future__ import annotations

from paperloom.plans import element_queries, library_queries, paper_queries, text_queries  # noqa: F401  they register themselves
from paperloom.plans.registry import ORACLE_SQL, QUERIES

FLAGSHIP = "hybrid_search"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
