"""Registry of the engine's queries and of the equivalent SQL."""

from __future__ import annotations

from noteloom.plans import archive, archive_sql, knowledge, retrieval

QUERIES = retrieval.QUERIES | knowledge.QUERIES | archive.QUERIES
ORACLES = retrieval.ORACLES | knowledge.ORACLES | archive_sql.ORACLES
