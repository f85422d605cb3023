"""Registered query plans (fixed-parameter report calls over the fixture) and
their DuckDB oracle SQL, plus plan-inspection helpers for tests."""

from .oracle import oracle_sql
from .registry import queries

__all__ = ["oracle_sql", "queries"]
