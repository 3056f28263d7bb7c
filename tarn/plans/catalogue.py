"""All queries over the driver's tables."""

from __future__ import annotations

from tarn.plans import document_queries, lookup_queries, package_queries, plan_queries, source_queries, table_queries  # noqa: F401
from tarn.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
