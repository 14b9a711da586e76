"""Name -> query and name -> SQL of the engine's own operators."""

from . import learned, queries, twins

QUERIES = queries.QUERIES | learned.QUERIES
ORACLE_SQL = twins.ORACLE_SQL | learned.ORACLE_SQL
