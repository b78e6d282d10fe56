"""Registered queries over the test tables, each with its SQL oracle where SQL can express it."""

from gleanery.plans import scalars, scoring_queries, store_queries, trend_queries
from gleanery.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "scalars", "scoring_queries", "store_queries", "trend_queries"]
