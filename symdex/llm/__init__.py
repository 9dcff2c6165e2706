"""Operators for training-data pipelines and the queries on them. Nothing outside this package imports it."""

from .catalog import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
