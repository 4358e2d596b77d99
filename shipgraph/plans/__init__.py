"""Registered queries (Spark) and their DuckDB oracle SQL."""

from .catalog import QUERIES, ORACLE

__all__ = ["QUERIES", "ORACLE"]
