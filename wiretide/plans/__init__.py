"""Queries over the driver's tables, with SQL that gives the same rows."""

from .captures import CAPTURE_QUERIES, CAPTURE_SQL
from .fact_queries import FACT_QUERIES, FACT_SQL
from .rule_queries import RULE_QUERIES, RULE_SQL
from .tables import ORACLE_SQL as TABLE_SQL
from .tables import TABLE_QUERIES

QUERIES = {**TABLE_QUERIES, **CAPTURE_QUERIES, **RULE_QUERIES, **FACT_QUERIES}
ORACLE_SQL = {**TABLE_SQL, **CAPTURE_SQL, **RULE_SQL, **FACT_SQL}

__all__ = ["ORACLE_SQL", "QUERIES"]
