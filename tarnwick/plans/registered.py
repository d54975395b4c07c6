"""All queries of the engine, and their SQL."""

from tarnwick.plans import queries, strategy_queries, verifier_queries

QUERIES = queries.QUERIES | verifier_queries.QUERIES | strategy_queries.QUERIES
ORACLE_SQL = queries.ORACLE_SQL | verifier_queries.ORACLE_SQL | strategy_queries.ORACLE_SQL
