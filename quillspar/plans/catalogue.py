"""All queries of the engine."""

from __future__ import annotations

from . import evidence, jobs, records, retrieval

QUERIES = retrieval.QUERIES | evidence.QUERIES | jobs.QUERIES | records.QUERIES
ORACLE_SQL = retrieval.ORACLE_SQL | evidence.ORACLE_SQL | jobs.ORACLE_SQL | records.ORACLE_SQL
