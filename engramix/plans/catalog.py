"""All registered core queries and their oracle SQL."""

from __future__ import annotations

from . import intake_queries, record_queries, run_queries, search_queries, state_queries, table_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
