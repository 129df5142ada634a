"""All queries of the library, and their SQL where SQL can express them. CHECKS are over fixed cases and only for tests."""

from __future__ import annotations

from sumforge.plans import latex_queries, other_queries, saturation_queries, stage_queries, store_queries, vector_queries

_PARTS = (vector_queries, store_queries, latex_queries, other_queries, saturation_queries, stage_queries)

QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
CHECKS = {name: f for part in (latex_queries, other_queries, stage_queries) for name, f in part.CHECKS.items()}
EXPECTED = {name: sql for part in _PARTS for name, sql in part.ORACLE_SQL.items()}
ORACLE_SQL = {name: sql for name, sql in EXPECTED.items() if name in QUERIES}
