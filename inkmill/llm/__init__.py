"""Operators for training data; nothing outside this subpackage imports it."""

from inkmill.llm.queries import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
