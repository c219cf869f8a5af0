"""The engine's own queries by name, with the SQL that each is checked against."""

from __future__ import annotations

from .plans import cases_evaluation, cases_graph, cases_retrieval, cases_sources, cases_text  # noqa: F401  registers its queries
from .plans.registry import ORACLE_SQL, QUERIES

FLAGSHIP = "qa_search"
__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
