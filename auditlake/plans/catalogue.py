"""All queries over the driver's tables, and their statements in SQL."""

from auditlake.plans import audit, capture, evidence, lookup, ordered, precedence, review, scores

QUERIES = audit.QUERIES | ordered.QUERIES | evidence.QUERIES | capture.QUERIES | review.QUERIES | scores.QUERIES | lookup.QUERIES | precedence.QUERIES
ORACLE_SQL = audit.ORACLE_SQL | ordered.ORACLE_SQL | evidence.ORACLE_SQL | capture.ORACLE_SQL | review.ORACLE_SQL | scores.ORACLE_SQL | lookup.ORACLE_SQL | precedence.ORACLE_SQL
