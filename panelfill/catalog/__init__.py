"""Registered queries: each operator run on the survey tables, with SQL for the same result."""

from panelfill.catalog.base import ORACLE, QUERIES
from panelfill.catalog import aggregates, expressions, joins, models, reports, sources, statistics  # noqa: F401

__all__ = ["ORACLE", "QUERIES"]
