"""Registered queries over the given tables, each beside its SQL counterpart."""

from catalog import panel_queries, source_queries  # noqa: F401
from catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
