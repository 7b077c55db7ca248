"""Registered queries and their SQL counterparts."""

from stormlane.plans.queries import ORACLE_SQL, QUERIES, flagship

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]
