"""All queries of the library by name."""

from __future__ import annotations

from tessera.plans import answering, approximate, dimensions, grounding, lifecycle, operations, operations_sql, publishing, retrieval, rules, text, tickets
from tessera.plans._tables import Query

QUERIES: dict[str, Query] = retrieval.QUERIES | text.QUERIES | operations.QUERIES | rules.QUERIES | lifecycle.QUERIES | dimensions.QUERIES | grounding.QUERIES | approximate.QUERIES | tickets.QUERIES | publishing.QUERIES | answering.QUERIES
ORACLE_SQL: dict[str, str] = retrieval.ORACLE_SQL | text.ORACLE_SQL | operations_sql.ORACLE_SQL | rules.ORACLE_SQL | lifecycle.ORACLE_SQL | dimensions.ORACLE_SQL | grounding.ORACLE_SQL | tickets.ORACLE_SQL | publishing.ORACLE_SQL | answering.ORACLE_SQL
