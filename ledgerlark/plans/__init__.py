"""Registered queries of the engine and the SQL that each must agree with."""

from ledgerlark.plans import io_queries, statement_queries, text_queries  # noqa: F401
from ledgerlark.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
